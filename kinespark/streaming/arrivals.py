"""Frames as they arrive: the running peak of each curve in Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_peaks(samples: DataFrame, keys: list[str], late: str = "10 minutes", window: str = "1 hour", ts: str = "ts", value: str = "activity") -> DataFrame:
    """The highest sample of each curve in each window of time; samples later than late are dropped. Batch tables work as well."""
    marked = samples.withWatermark(ts, late) if samples.isStreaming else samples
    return marked.groupBy(F.window(ts, window).alias("span"), *keys).agg(F.max(value).alias("peak_value"), F.count("*").alias("n")).select(*keys, F.col("span.start").alias("start"), "peak_value", "n")
