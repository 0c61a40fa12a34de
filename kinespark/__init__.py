"""Kinetic time-series analytics on Spark DataFrames."""
