"""The sweep against plain Lloyd and MLlib, and the two-step stage: what it makes, and that a stopped run goes on."""

import shutil

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from kinespark.operators import components, two_step
from kinespark.plans import catalogue, stage_queries
from kinespark.sources import tables


def cost_of(x, centers):
    return ((x[:, None, :] - centers[None]) ** 2).sum(2).min(1).sum()


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vox_id long, point array<double>").repartition(3)


def test_sweep_reaches_fixed_points(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.3, (60, 3)) for c in ((0, 0, 0), (4, 0, 0), (0, 5, 0), (3, 3, 3))])
    for m in components.fit_sweep(table(spark, x), (2, 4), (1, 2), tolerance=1e-9):
        own = ((x[:, None, :] - m.centers[None]) ** 2).sum(2).argmin(1)
        assert np.allclose(m.centers, [x[own == i].mean(0) for i in range(m.k)]) and m.cost == pytest.approx(cost_of(x, m.centers))
    labels = {r["vox_id"]: r["label"] for r in components.kmeans_sweep(table(spark, x), (4,)).collect()}
    groups = [{labels[i] for i in range(60 * g, 60 * g + 60)} for g in range(4)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 4


def test_sweep_on_few_and_odd_points(spark):
    few = components.fit_sweep(table(spark, np.array([[0.0, 0], [0, 0], [1, 1]])), (5,), (3,))
    assert len(few[0].centers) == 2 and few[0].cost == 0
    df = table(spark, np.array([[0.0, 0], [3, 3]])).unionByName(spark.createDataFrame([(7, None)], "vox_id long, point array<double>"))
    assert {r["vox_id"] for r in components.kmeans_sweep(df, (2,)).collect()} == {0, 1}
    assert components.kmeans_sweep(df.limit(0), (2,)).count() == 0 == len(components.fit_sweep(df.limit(0), (2,)))


def test_sweep_costs_no_more_than_mllib(spark):
    points = catalogue._points(spark, "/root/testdata/sf0.01")
    ks = (6, 14)
    models = components.fit_sweep(points, ks)
    features = points.select(array_to_vector("point").alias("features")).cache()
    for k in ks:
        theirs = min(KMeans(k=k, seed=s, maxIter=50).fit(features).summary.trainingCost for s in (42, 43, 44))
        assert min(m.cost for m in models if m.k == k) <= 1.01 * theirs
    features.unpersist()


def test_two_step_run_goes_on_where_it_was_stopped(spark, sf, tmp_path):
    go = lambda path, **changed: stage_queries.two_step_run(spark, sf, str(path), first_ks=(3, 5), rounds=10, **changed)
    run, first, mask, second, curves = go(tmp_path / "a")
    assert run.made[:2] == ["first-labels", "first-curves"] and run.made[-1] == "second-step-curves"
    (best,) = first.overall.collect()
    inside = {r["vox_id"] for r in first.labels.where(f"k = {best['k']} AND label = {best['label']}").collect()}
    assert {r["vox_id"] for r in mask.collect()} == inside and 0 < len(inside) < first.labels.where("k = 3").count()
    # The curves are the means of the second labels' voxels inside the mask.
    points = {r["vox_id"]: np.array(r["point"]) + 0.6 for r in catalogue._points(spark, sf).collect()}
    label = {r["vox_id"]: r["label"] for r in second.labels.collect()}
    got = {(r["label"], r["frame"]): (r["voxel_count"], r["activity"], r["sd"]) for r in curves.collect()}
    for one in {label[v] for v in inside}:
        own = np.array([points[v] for v in inside if label[v] == one])
        assert [got[one, f + 1] for f in range(own.shape[1])] == [(len(own), pytest.approx(m), pytest.approx(s, abs=1e-12)) for m, s in zip(own.mean(0), own.std(0))]
    outside = {label[v] for v in points if v not in inside}
    assert len(outside) == 1  # all zeros
    before = sorted(curves.collect())
    # Again: nothing is made. Stopped in the second step: what is left of it is made over, the first step stays.
    assert go(tmp_path / "a")[0].made == []
    for part in (tmp_path / "a").iterdir():
        if part.name.startswith("second-features"):
            next(part.glob("_SUCCESS")).unlink()
        elif part.name.startswith("second-step-curves"):
            shutil.rmtree(part)
    again = go(tmp_path / "a")
    assert again[0].made == ["second-features", "second-step-curves"] and sorted(again[-1].collect()) == before
    # Other parameters of the second step share the first.
    assert all(name.startswith("second") for name in go(tmp_path / "a", second_ks=(3,))[0].made)
    reduced = go(tmp_path / "a", reduce=0.5)
    assert reduced[0].made[0] == "first-mask" and reduced[2].count() <= mask.count()


def test_cached_tables_count_once_written(spark, tmp_path):
    path = tmp_path / "table"
    path.mkdir()
    (path / "_temporary").mkdir()
    made = tables.cached(spark, str(path), lambda: spark.range(3))
    assert made.count() == 3
    assert tables.cached(spark, str(path), lambda: spark.range(9)).count() == 3
    assert tables.cached(spark, str(path), lambda: spark.range(9), force=True).agg(F.count("*")).first()[0] == 9
