"""Exact quantiles by rounds of counts, densities whose values meet near points only, and convolution in the row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinespark.functions import curves
from kinespark.functions.quantiles import quantiles
from kinespark.operators import kinetics

RNG = np.random.default_rng(3)
SETS = {
    "even": RNG.random(500),
    "ties": np.repeat([1.0, 2.0, 5.0], [400, 1, 99]),
    "one value": np.full(7, -3.5),
    "one row": np.array([4.0]),
    "far apart": np.concatenate([RNG.random(300) * 1e-12, [1e300, -1e300]]),
    "two": np.array([-1.7e308, 1.7e308 / 2]),
}


@pytest.mark.parametrize(("share", "bins", "few"), [(0.37, 1024, 10_000), (1.0, 1024, 10_000), (0.0, 1024, 0), (0.37, 1024, 0), (0.95, 1024, 0), (1.0, 1024, 0), (0.37, 16, 30)])
def test_quantiles_are_exact(spark, share, bins, few):
    use = {k: v for k, v in SETS.items() if bins > 16 or k != "far apart"}  # few bins find far values in many rounds
    rows = [(k, i % 2, float(v), "x") for k, values in use.items() for i, v in enumerate(values)]
    rows += [(None, 0, 2.0, "x"), (None, 0, 4.0, "x"), ("even", 0, None, "x"), ("even", 1, float("nan"), "x"), ("ties", 0, float("inf"), "x"), ("nothing", 0, None, "x")]
    made = spark.createDataFrame(rows, "k0 string, bin int, v double, low string").repartition(4)
    got = {r["k0"]: r["v"] for r in quantiles(made, ["k0"], "v", share, bins, few).collect()}
    assert got.pop(None) == pytest.approx(2 + 2 * share)
    assert got.keys() == use.keys()
    for k, values in use.items():
        a, b = (np.sort(values)[int(f(share * (len(values) - 1)))] for f in (np.floor, np.ceil))
        part = share * (len(values) - 1) % 1
        assert got[k] == (pytest.approx(a * (1 - part) + b * part, rel=1e-9) if k != "far apart" else pytest.approx(a + (b - a) * part, rel=1e-9))


def test_quantiles_by_two_keys_of_no_rows_and_of_wrong_shares(spark):
    made = spark.createDataFrame([(a, b, float(i)) for a in (1, 2) for b in (1, 2) for i in range(a * 10 + b)], "a int, b int, x double")
    got = {(r["a"], r["b"]): r["x"] for r in quantiles(made, ["a", "b"], "x", 0.95).collect()}
    assert got == {(a, b): pytest.approx(0.95 * (a * 10 + b - 1)) for a in (1, 2) for b in (1, 2)}
    assert quantiles(made.where("a > 2"), ["a"], "x", 0.5).count() == 0
    with pytest.raises(ValueError):
        quantiles(made, ["a"], "x", 1.5)


def test_density_is_that_of_all_points(spark):
    values = np.round(np.concatenate([RNG.normal(0, 1, 300), RNG.normal(50, 0.2, 100), [400.0]]), 3)
    rows = spark.createDataFrame([("r", float(v)) for v in values], "region string, v double")
    got = kinetics.kde_fwhm(rows, ["region"], "v").first()
    grid = np.linspace(values.min(), values.max(), 1000)
    h = values.std(ddof=1) * len(values) ** -0.2
    density = np.exp(-(((grid[:, None] - values) / h) ** 2) / 2).sum(1) / (len(values) * h * np.sqrt(2 * np.pi))
    over = grid[density > density.max() / 2]
    assert (got["left"], got["peak"], got["right"], got["max_density"]) == pytest.approx((over.min(), grid[density.argmax()], over.max(), density.max()), rel=1e-9)



def test_convolution_in_the_row(spark):
    x = RNG.random(40)
    rows = spark.createDataFrame([(c, i, float(v * c)) for c in (1, 2) for i, v in enumerate(x)] + [(3, 0, 1.0), (3, 1, None), (3, 2, 1.0)], "c int, frame int, activity double").repartition(3)
    got = {(r["c"], r["frame"]): r["activity"] for r in curves.convolve(rows, lambda lag: F.exp(F.lit(-0.3) * lag), ["c"], step=0.5).collect()}
    for c in (1, 2):
        assert [got[c, i] for i in range(40)] == pytest.approx((np.convolve(x * c, np.exp(-0.3 * np.arange(40)))[:40] * 0.5).tolist())
    assert [got[3, i] for i in range(3)] == pytest.approx([0.5, 0.5 * np.exp(-0.3), 0.5 * (1 + np.exp(-0.6))])
