"""Closed-form answers on small tables."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinespark.functions import curves
from kinespark.operators import clusters, kinetics, lattice, tracer
from kinespark.sources import tables


def test_line_and_area(spark):
    rows = spark.createDataFrame([(1, i + 1, t, 2 * t + 1) for i, t in enumerate([0.0, 1.0, 3.0, 7.0])], "c long, frame long, t double, activity double")
    line = curves.lines(rows, ["c"]).first()
    assert line["whole_slope"] == pytest.approx(2) and line["wo_first_intercept"] == pytest.approx(1)
    assert curves.auc(rows, ["c"]).first()["auc"] == pytest.approx(56)
    assert curves.peak(rows, ["c"]).first()["peak_index"] == 4


def test_timing(spark):
    times = spark.createDataFrame([(1, t, True) for t in (1.0, 2.0, 4.0, 8.0)], "c long, t double, used boolean")
    assert [r["duration"] for r in curves.timing(times, ["c"]).orderBy("t_mid").collect()] == [1, 1, 2, 4]


def test_blobs(spark):
    cube = [(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
    far = [(x + 4, y + 4, z + 4) for x, y, z in cube]
    corner = [(2, 2, 2)]
    cells = spark.createDataFrame([(1, x * 36 + y * 6 + z, x, y, z) for x, y, z in cube + far + corner], "k int, vox_id long, x int, y int, z int")
    sizes = sorted(r["n"] for r in lattice.blob_sizes(lattice.blobs(cells, ["k"]), ["k"]).collect())
    assert sizes == [8, 9]


def test_sparsity(spark):
    sizes = spark.createDataFrame([(1, i, n) for i, n in enumerate([90, 6, 3, 1])], "k int, blob int, n int")
    assert lattice.sparsity(sizes, ["k"]).where("kept").count() == 2


def test_dice(spark):
    labels = spark.createDataFrame([(1, v, 1 if v < 2 else 2) for v in range(6)] + [(2, v, 1) for v in range(6)], "k int, vox_id int, label int")
    found = clusters.dice(labels).where("k1 = 1 AND label1 = 1 AND k2 = 2").first()
    assert found["dice"] == pytest.approx(0.5)


def test_convolution_of_a_step(spark):
    rows = spark.createDataFrame([(1, i, 1.0) for i in range(5)], "c int, frame int, activity double")
    got = curves.convolve(rows, lambda lag: F.lit(1.0), ["c"], step=0.1).orderBy("frame").collect()
    assert [r["activity"] for r in got] == pytest.approx([0.1 * (i + 1) for i in range(5)])


def test_interpolation_at_and_beyond_the_ends(spark):
    rows = spark.createDataFrame([(1, 0.0, 1.0), (1, 2.0, 5.0)], "c int, t double, activity double")
    grid = spark.createDataFrame([(1, t) for t in (-1.0, 0.0, 1.0, 2.0, 3.0)], "c int, t double")
    clamp = {r["t"]: r["activity"] for r in curves.interpolate(rows, grid, ["c"]).collect()}
    assert clamp == {-1.0: 1.0, 0.0: 1.0, 1.0: 3.0, 2.0: 5.0, 3.0: 5.0}


def test_pchip_keeps_knots_and_monotony(spark):
    rows = spark.createDataFrame([(1, float(i), float(v)) for i, v in enumerate([0, 0, 1, 5, 5])], "c int, t double, activity double")
    got = [r["activity"] for r in curves.pchip(rows, ["c"], steps=4).orderBy("t").collect()]
    assert got[::4] == pytest.approx([0, 0, 1, 5, 5]) and (np.diff(got) >= -1e-12).all()


def decaying(curve_id, t, off=0.0):
    return [(curve_id, float(x), float(30 * np.exp(-0.5 * x) + 10 * np.exp(-0.05 * x) + off * (-1) ** i), 1.0) for i, x in enumerate(t)]


DECAYING = "curve_id long, t double, activity double, sigma double"


def test_decay_is_recovered(spark):
    fits = tracer.fit_decays(spark.createDataFrame(decaying(1, np.linspace(0, 20, 40)), DECAYING), terms=2)
    best = tracer.best_fits(fits).first()
    assert [(x["c"], x["rate"]) for x in best["terms"]] == [pytest.approx((30, 0.5), rel=0.05), pytest.approx((10, 0.05), rel=0.05)]
    assert fits.where("code = 0").count() == 10


def test_failures_are_counted_by_code(spark):
    rows = decaying(1, np.linspace(0, 20, 40)) + decaying(2, np.linspace(0, 20, 40), 50.0)
    fits = tracer.fit_decays(spark.createDataFrame(rows, DECAYING), failures=6, terms=2)
    assert {r["curve_id"] for r in fits.where("code = 0").collect()} == {1}  # no decay comes near the other curve
    assert fits.where("curve_id = 2").agg(F.sum("n")).first()[0] == 6
    assert all(r["reason"] == tracer.FAILURES[r["code"]] for r in tracer.failure_counts(fits).collect())


RATES = {"a": (0.4, 0.3, 0.1), "b": (0.25, 0.2, 0.07), "c": (0.3, 0.35, 0.15)}


def simulated():
    t = np.arange(0.0, 40.0, 0.5)
    source = 50 * t * np.exp(-0.8 * t) + 20 * (1 - np.exp(-t)) * np.exp(-0.1 * t)
    return t, source, {r: tracer.tissue(t, source, np.array(k)) for r, k in RATES.items()}


def test_rates_are_recovered_by_bootstrap(spark):
    t, source, curves_of = simulated()
    rows = spark.createDataFrame([(float(a), float(b), float(0.01 * b), 1.0) for a, b in zip(t, source, strict=True)], "t double, activity double, sd double, sigma double")
    raw = [(r, float(a), float(0.95 * y + 0.05 * s)) for r, ys in curves_of.items() for a, y, s in zip(t, ys, source, strict=True)]
    regions = spark.createDataFrame(raw, "region string, t double, activity double")
    sets = tracer.bootstrap(rows, regions, n=12, terms=3).cache()
    good = tracer.good_sets(sets)
    assert good.count() >= 3 * 8
    for r in good.groupBy("region").agg(*[F.avg(c).alias(c) for c in ("k1", "k2", "k3")]).collect():
        assert (r["k1"], r["k2"], r["k3"]) == pytest.approx(RATES[r["region"]], rel=0.05)
    again = tracer.bootstrap(rows, regions, n=12, terms=3)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, sets.collect()), key=str)
    assert tracer.long_rates(sets).count() == 4 * good.count()
    sets.unpersist()


def test_a_set_with_a_constant_at_its_bound_is_rejected_whole(spark):
    t, source, curves_of = simulated()
    rows = spark.createDataFrame([(float(a), float(b), 0.0, 1.0) for a, b in zip(t, source, strict=True)], "t double, activity double, sd double, sigma double")
    flat = tracer.tissue(t, source, np.array([3.0, 0.3, 0.1]))
    regions = spark.createDataFrame([(r, float(a), float(y)) for r, ys in (("a", curves_of["a"]), ("z", flat)) for a, y in zip(t, ys, strict=True)], "region string, t double, activity double")
    sets = tracer.bootstrap(rows, regions, n=2, percent=0.0, failures=150).collect()
    assert sets and all(r["region"] is None for r in sets) and {r["code"] for r in sets} & {tracer.NEAR_ZERO, tracer.NEAR_ONE}


def test_annealing_finds_the_rates_within_the_bounds(spark):
    t, source, _ = simulated()
    rows = [(r, float(a), float(v), 1.0) for r, k in RATES.items() for a, v in zip(t, tracer.tissue(t, source, np.array(k)), strict=True)]
    regions = spark.createDataFrame(rows, "region string, t double, activity double, weight double")
    ki = {r: k[0] * k[2] / (k[1] + k[2]) for r, k in RATES.items()}
    bounds = spark.createDataFrame([(r, p, 0.8 * v, v, 1.2 * v) for r, k in RATES.items() for p, v in zip(("k1", "k2", "k3", "ki"), (*k, ki[r]), strict=True)], "region string, param string, low double, peak double, high double")
    found = tracer.anneal(regions, bounds, 0.5, steps=60).collect()
    assert len(found) == 9 and len({r["source"] for r in found}) == 3
    plain = lambda rates: {r["source"]: r["cost"] for r in kinetics.source_to_target_cost(framed, rates, peaks, 0.5).collect()}
    framed = regions.select("region", (F.col("t") * 2).cast("int").alias("frame"), "activity", "weight")
    peaks = bounds.where("param = 'ki'").select("region", F.col("peak").alias("ki"))
    true = plain(spark.createDataFrame([(r, *k) for r, k in RATES.items()], "region string, k1 double, k2 double, k3 double"))
    own = plain(spark.createDataFrame([(r["region"], r["k1"], r["k2"], r["k3"]) for r in found if r["source"] == "b"], "region string, k1 double, k2 double, k3 double"))
    for r in found:
        assert r["cost"] <= true[r["source"]] and r["ki"] == pytest.approx(ki[r["region"]], rel=0.2)
        assert r["source"] != "b" or r["cost"] == pytest.approx(own["b"])
        assert all(0.8 * v - 1e-9 <= r[p] <= 1.2 * v + 1e-9 for p, v in zip(("k1", "k2", "k3"), RATES[r["region"]], strict=True))
    with pytest.raises(Exception, match="not step apart"):
        tracer.anneal(regions, bounds, 0.7, steps=1).collect()


def test_production_numbers_of_draws_and_steps():
    default = lambda f, name: inspect.signature(f).parameters[name].default
    assert default(tracer.bootstrap, "n") == 500 and default(tracer.anneal, "steps") == 5000
    assert (default(tracer.fit_decays, "successes"), default(tracer.fit_decays, "failures")) == (10, 4096)


def test_the_full_curve_is_linear_then_the_fit(spark):
    rows = spark.createDataFrame([(1, 0.2, 2.0), (1, 0.4, 6.0), (1, 1.0, 1.0)], "c int, t double, activity double")
    fits = spark.createDataFrame([(1, [(3.0, 0.5)])], "c int, terms array<struct<c: double, rate: double>>")
    got = {r["i"]: r["activity"] for r in kinetics.full_curve(rows, fits, ["c"]).collect()}
    assert got == pytest.approx({i: (20 * 0.1 * i - 2) if i < 4 else 3 * np.exp(-0.05 * i) for i in range(11)})


def test_confetti_against_a_loop(spark):
    rows = spark.createDataFrame([(1, z, z + 1) for z in range(20)], "label int, z int, n int").withColumn("total", F.lit(210))
    bounds = lattice.confetti_bounds(F.lit(9.5), 12.0, -110.0)
    got = lattice.confetti(rows, ["label"], "total", **bounds).first()
    com = 9.5 * 12 - 110
    low, high, weak, strong = (int((com + mm + 110) / 12) for mm in (-33.6, 84.0, -31.9, -67.7))
    score = sum((z + 1) / 210 * (-5.0 * (low <= z <= high) + 0.5 * (z < weak) + (z < strong) + (z < 10)) for z in range(20))
    assert got["score"] == pytest.approx(score) and got["likely_confetti"] == (score > 0)


def test_world_axes_and_corners(spark):
    affine = [[-2.0, 0, 0, 90], [0, 2, 0, -120], [0, 0, 3, -70], [0, 0, 0, 1]]
    assert lattice.superior_axis((10, 12, 14), affine) == (2, 1)
    assert lattice.superior_axis((10, 12, 14), [affine[0], affine[1], [0, 0, -3, 70], affine[3]]) == (2, -1)
    shape = spark.createDataFrame([(10, 12, 14)], "nx int, ny int, nz int")
    got = {(r["wx"], r["wy"], r["wz"]) for r in lattice.world_corners(shape, affine).collect()}
    assert got == {(x, y, z) for x in (90.0, 70.0) for y in (-120.0, -96.0) for z in (-70.0, -28.0)}


def test_images_round_trip(spark, tmp_path):
    image = np.arange(2 * 3 * 2 * 2, dtype=float).reshape(2, 3, 2, 2)
    (tmp_path / "a.nii").write_bytes(tables.encode_nifti(image))
    got = {(r["x"], r["y"], r["z"], r["frame"]): r["activity"] for r in tables.read_images(spark, str(tmp_path / "*.nii")).collect()}
    assert got == {(x, y, z, t + 1): image[x, y, z, t] for x in range(2) for y in range(3) for z in range(2) for t in range(2)}


def test_curve_files(spark, tmp_path):
    path = tmp_path / "s.tsv"
    path.write_text("MidTime\tcin\thip\n1\t2\t3\n2\t4\t5\n")
    got = tables.read_curves(spark, str(path), ["hip", "absent"], ignored=(1,)).collect()
    assert [(r["frame"], r["t"], r["region"], r["activity"]) for r in got] == [(2, 2.0, "hip", 5.0)]
    made = tables.cached(spark, str(tmp_path / "c"), lambda: spark.range(3))
    assert made.count() == tables.cached(spark, str(tmp_path / "c"), lambda: spark.range(9)).count() == 3


TRAITS = "k int, label int, peak_index int, peak_value double, vascular boolean"


def test_scattered_clusters_are_not_the_best(spark):
    found = spark.createDataFrame([(6, 1, 2, 9.0, True), (6, 2, 3, 5.0, True)], TRAITS)
    flags = spark.createDataFrame([(6, 1, True), (6, 2, False)], "k int, label int, likely_confetti boolean")
    best = lambda **switch: [r["label"] for r in clusters.best_in_k(found, flags, **switch).collect()]
    assert best() == [2] and best(keep_confetti=True) == [1]


def test_an_alternate_has_fewer_blobs(spark):
    found = spark.createDataFrame([(6, 1, 2, 5.0, True), (6, 2, 3, 9.0, True), (6, 3, 3, 8.0, True)], TRAITS)
    best = clusters.best_in_k(found)

    def labels(**blobs):
        sizes = spark.createDataFrame([(6, int(i[1:]), b, 4) for i, n in blobs.items() for b in range(n)], "k int, label int, blob int, n int")
        return [r["label"] for r in clusters.alternates(found, best, sizes).collect()]

    assert labels(l1=3, l2=2, l3=1) == [2]
    assert labels(l1=3, l2=3, l3=1) == []  # the highest alone is compared
