"""Rate tables from curves: recovered constants, a run that goes on, and no good set."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinespark.operators import rates, tracer

RATES = {"a": (0.4, 0.3, 0.1), "b": (0.25, 0.2, 0.07), "c": (0.3, 0.35, 0.15)}


def tables(spark, sd=0.01):
    t = np.arange(0.0, 40.0, 0.5)
    source = 50 * t * np.exp(-0.8 * t) + 20 * (1 - np.exp(-t)) * np.exp(-0.1 * t)
    vessel = spark.createDataFrame([(float(a), float(b), float(sd * b), 1.0) for a, b in zip(t, source)], "t double, activity double, sd double, sigma double")
    rows = [(r, float(a), float(0.95 * y + 0.05 * s)) for r, k in RATES.items() for a, y, s in zip(t, tracer.tissue(t, source, np.array(k)), source)]
    return t, source, vessel, spark.createDataFrame(rows, "region string, t double, activity double")


def test_rates_from_curves_to_the_final_table(spark, tmp_path):
    t, source, vessel, regions = tables(spark)
    plan = rates.RatePlan("simulated", copies=12, anneal_steps=300)
    run, found = rates.rate_tables(vessel, regions, plan, str(tmp_path / "run"))
    assert run.made == ["fit", "fitted", "corrected", "sets", "bounds", "annealed", "means"]
    fitted = {r["t"]: r["activity"] for r in found.fitted.collect()}
    late = t >= t[source.argmax()]
    off = np.abs(np.array([fitted[x] for x in t[late]]) - source[late])  # three decays near the peak of a gamma curve
    assert off.max() < 0.05 * source.max() and off[10:].max() < 0.5
    clean = {(r["region"], r["t"]): r["activity"] for r in found.corrected.collect()}
    for r, k in RATES.items():
        assert np.allclose([clean[r, x] for x in t[late]], tracer.tissue(t, source, np.array(k))[late], rtol=0.02)
    for r in found.means.collect():
        assert r["sources"] == 3 and (r["k1"], r["k2"], r["k3"]) == pytest.approx(RATES[r["region"]], rel=0.05)
        assert r["ki"] == pytest.approx(RATES[r["region"]][0] * RATES[r["region"]][2] / sum(RATES[r["region"]][1:]), rel=0.05)
    again = rates.rate_tables(vessel, regions, plan, str(tmp_path / "run"))
    assert again[0].made == [] and sorted(again[1].means.collect()) == sorted(found.means.collect())
    more = rates.rate_tables(vessel, regions, rates.RatePlan("simulated", copies=12, anneal_steps=310), str(tmp_path / "run"))
    assert more[0].made == ["annealed", "means"]


def test_without_a_good_set_the_tables_are_empty(spark, tmp_path):
    _, _, vessel, regions = tables(spark)
    flat = regions.withColumn("activity", F.lit(0.0))  # every constant ends at 0
    _, found = rates.rate_tables(vessel, flat, rates.RatePlan("flat", copies=2, percent=0.0, anneal_steps=10, failures=5), str(tmp_path / "run"))
    assert found.means.count() == 0 == found.bounds.count() and found.sets.where("code = 0").count() == 0


def test_even_times(spark):
    rows = spark.createDataFrame([("a", x, x * x) for x in (1.0, 2.0, 4.0, 5.0)], "region string, t double, activity double")
    got = {r["t"]: r["activity"] for r in rates.even(rows, ["region"], 0.5).collect()}
    assert sorted(got) == [1 + i / 2 for i in range(9)] and all(got[x] == pytest.approx(x * x) for x in (1.0, 2.0, 4.0, 5.0))
