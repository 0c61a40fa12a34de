"""Each query against its SQL in DuckDB, or, without SQL, for rows."""

import inspect
import os
from collections import defaultdict
from glob import glob

import duckdb
import numpy as np
import pytest

from kinespark.operators import components
from kinespark.plans import image_queries, input_queries, proxies, stage_queries  # noqa: F401
from kinespark.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(columns, found):
    order = sorted(columns)
    place = [list(columns).index(c) for c in order]
    same = lambda v: float(f"{v:.10g}") if isinstance(v, float) else v
    return order, sorted((tuple(same(r[i]) for i in place) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        assert got == rows([c[0] for c in found.description], found.fetchall())
    assert got[1] or name in ("q_alternate", "q_json_sidecar")


def test_components_are_those_of_whole_curves(spark, sf):
    read = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    points = {r["vec_id"]: np.array(r["embedding"], float) for r in read}
    centred = np.stack([p - p.mean() for p in points.values()])
    top = np.linalg.svd(centred, compute_uv=False)[:6] ** 2
    sums = QUERIES["q_pca"](spark, sf).groupBy("component").agg({"score": "count"}).collect()
    assert sorted(tuple(r) for r in sums) == [(i, len(points)) for i in range(1, 7)]
    energy = defaultdict(float)
    for r in QUERIES["q_pca"](spark, sf).collect():
        energy[r["component"]] += r["score"] ** 2
    assert [energy[i] for i in range(1, 7)] == pytest.approx(top, rel=1e-4)
    whole, few = defaultdict(float), set()
    for r in QUERIES["q_ica"](spark, sf).collect():
        if r["n"] == centred.shape[1] - 1:
            whole[r["vox_id"]] += r["score"] ** 2 * centred.shape[1]
        else:
            few.add((r["n"], r["component"]))
    assert few == {(6, i) for i in range(1, 7)}
    assert [whole[i] for i in points] == pytest.approx((centred**2).sum(1), rel=1e-2)


def test_every_cluster_of_every_k_gets_a_fit(spark, sf):
    found = QUERIES["q_curve_fit"](spark, sf).select("k", "label").collect()
    assert sorted(tuple(r) for r in found) == [(k, i) for k in proxies.KS for i in range(1, k + 1)]


def test_the_sweep_has_all_ks_and_the_best_of_three_seeds(spark, sf, monkeypatch):
    called = []
    monkeypatch.setattr(components, "kmeans_sweep", lambda points, ks, seeds=inspect.signature(components.kmeans_sweep).parameters["seeds"].default: called.append((ks, seeds)))
    QUERIES["q_kmeans_mllib"](spark, sf)
    assert called == [(tuple(range(6, 39, 4)), (42, 43, 44))]
