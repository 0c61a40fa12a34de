"""Tables of clusters and of curves of all kinds, sets of curves at their times, readers by place, and sinks of components."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinespark.functions import curves
from kinespark.operators import clusters, components, kinetics, lattice
from kinespark.sources import inputs, tables

CURVES = {(2, 1): [0.0, 4.0, 2.0, 1.0], (2, 2): [0.0, 1.0, 2.0, 3.0]}
T = [0.5, 1.0, 2.0, 4.0]


def _clusters(spark):
    means = spark.createDataFrame([(k, i, f + 1, T[f], v, 6 if i == 1 else 2) for (k, i), c in CURVES.items() for f, v in enumerate(c)], "k int, label int, frame int, t double, activity double, voxel_count long")
    sizes = spark.createDataFrame([(2, 1, 0, 4), (2, 1, 9, 1), (2, 1, 11, 1)], "k int, label int, blob long, n long")
    return means, sizes


def test_table_of_clusters(spark):
    means, sizes = _clusters(spark)
    found = clusters.traits(means)
    best = spark.createDataFrame([(2, 1)], "k int, label int")
    made = clusters.table(found, means, sizes, best, best, {"subject": "s", "step": 2}, share=0.8)
    assert made.columns[:5] == ["subject", "step", "k", "label", "name"]
    a, b = (r.asDict() for r in made.orderBy("label").collect())
    assert (a["subject"], a["step"], a["name"], a["voxels_in_img"], a["blob_count"], a["voxels_per_blob"], a["sparsity"]) == ("s", 2, "l-1_k-2", 8, 3, 2.0, 2)
    assert (b["name"], b["blob_count"], b["voxels_per_blob"], b["sparsity"], b["irreversible"]) == ("l-2_k-2", 0, 0.0, 0, True)
    assert (a["best_in_k"], a["best_overall"], b["best_in_k"], b["best_overall"]) == (True, True, False, False)
    assert a["auc"] == pytest.approx(np.trapezoid(CURVES[2, 1], T))
    slope, intercept = np.polyfit(T, CURVES[2, 1], 1)
    later = np.polyfit(T[1:], CURVES[2, 1][1:], 1)
    assert [a[c] for c in ("whole_slope", "whole_intercept", "wo_first_slope", "wo_first_intercept")] == pytest.approx([slope, intercept, *later])
    assert clusters.table(found.limit(0), means.limit(0), sizes.limit(0), best, best).count() == 0


def test_curves_of_all_kinds(spark):
    means, _ = _clusters(spark)
    other = spark.createDataFrame([(0.5, 7.0, "left", None, 3)], "t double, activity double, name string, best_in_k boolean, depth int")
    made = clusters.plottable(means.withColumn("source", F.lit("x")), other, features=("depth", "voxel_count"))
    assert made.columns == ["t", "activity", "k", "label", "source", "name", "best_overall", "best_in_k", "depth", "voxel_count"]
    assert tuple(made.where("activity = 7").first()) == (0.5, 7.0, 0, 0, "n/a", "left", False, False, 3, None)
    one = made.where("activity = 4").first()
    assert (one["k"], one["label"], one["source"], one["name"], one["depth"], one["voxel_count"]) == (2, 1, "x", "n/a", None, 6)


def test_sets_of_curves_have_the_times_of_their_length(spark):
    times = spark.createDataFrame([("a", t, t >= 1) for t in T], "region string, t double, after_peak boolean")
    sets = lambda *rows: spark.createDataFrame(list(rows), "region string, curve int, values array<double>")
    made = curves.set_curves(sets(("a", 0, CURVES[2, 1]), ("a", 12, [9.0, 8.0, 7.0])), ["region"], times, "bs", "copies")
    got = sorted(map(tuple, made.collect()), key=lambda r: (r[3], r[2]))
    assert got == [("a", "copies", t, "_0000_bs", v) for t, v in zip(T, CURVES[2, 1], strict=True)] + [("a", "copies", t, "_0012_bs", v) for t, v in zip(T[1:], (9.0, 8.0, 7.0), strict=True)]
    for wrong in (("a", 1, [1.0, 2.0]), ("a", 1, []), ("b", 1, [1.0]), ("a", 1, None)):
        with pytest.raises(Exception, match="match neither all [04] times nor the [03] from the peak on"):
            curves.set_curves(sets(wrong), ["region"], times, "bs", "copies").collect()


def test_models_say_what_they_are(spark):
    made = spark.createDataFrame([("r", 0.5, 0.25, 0.75)], "name string, k1 double, k2 double, k3 double")
    got = made.select(kinetics.model(F.col("k1"), F.col("k2"), F.col("k3"), F.col("name")).alias("m")).first()["m"]
    assert got["ki"] == pytest.approx(0.375)
    assert got["text"] == "'r': ki = k1 * (k3 / (k2 + k3)) = 0.50 * (0.75 / (0.25 + 0.75)) = 0.38"


def test_the_first_place_is_read(spark, tmp_path):
    folder = tmp_path / "sub-7"
    (folder / "raw").mkdir(parents=True)
    (folder / "ses-abc01_tacs" / "out_file").mkdir(parents=True)
    wide = "MidTime\tleft\tright\n0.5\t1\t2\n1.5\t3\t4\n"
    for name in ("raw/7.tacs.tsv", "tacs.txt"):
        (folder / name).write_text(wide)
    (folder / "plasma.txt").write_text("time\tplasma_radioactivity\n1\t5\n")
    read = lambda *a, **o: inputs.read(spark, str(folder), "7", *a, **o)
    found, files = read("tacs", regions=["right"])
    assert [f.rsplit("sub-7/", 1)[1] for f in files] == ["raw/7.tacs.tsv", "tacs.txt"]
    assert sorted((r["frame"], r["t"], r["activity"]) for r in found.collect()) == [(1, 0.5, 2.0), (2, 1.5, 4.0)]
    assert [r["activity"] for r in read("plasma")[0].collect()] == [5.0]
    assert read("midtimes") == (None, [])
    (folder / "ses-abc01_tacs/out_file/wmparc_reoriented_tacs.tsv").write_text(wide.replace("MidTime", ""))
    times, files = read("midtimes", tracer="ABC", ignored=(1,))
    assert len(files) == 1 and sorted(map(tuple, times.collect())) == [(1, 0.5, False), (2, 1.5, True)]
    assert read("tacs", tracer="ABC")[1][0].endswith("wmparc_reoriented_tacs.tsv") and sorted(r["t"] for r in read("tacs", tracer="ABC")[0].collect()) == [0.5, 0.5, 1.5, 1.5]
    (folder / "midtimes.txt").write_text("3\n4\n")
    assert [r["t"] for r in read("midtimes", tracer="ABC")[0].orderBy("frame").collect()] == [3.0, 4.0]
    with pytest.raises(ValueError, match="none of"):
        read("blood")


def test_components_and_best_blobs_are_written(spark, tmp_path):
    scores = spark.createDataFrame([("pca", 2, v, c, float(v * c)) for v in range(4) for c in (1, 2)], "algorithm string, components int, vox_id long, component int, score double")
    cells = spark.createDataFrame([(v, v, 0, 0) for v in range(4)], "vox_id long, x int, y int, z int")
    tables.write_components(scores, components.component_stats(scores), cells, str(tmp_path / "c"))
    stats = spark.read.csv(str(tmp_path / "c/stats"), header=True, inferSchema=True)
    assert stats.columns[:3] == ["algorithm", "components", "component"] and stats.where("component = 2").first()["high"] == 6.0
    maps = spark.read.parquet(str(tmp_path / "c/maps"))
    assert {(r["component"], r["x"]): r["score"] for r in maps.collect()} == {(c, v): float(v * c) for v in range(4) for c in (1, 2)}
    means, sizes = _clusters(spark)
    blobs = lattice.sparsity(sizes, ["k", "label"])
    tables.write_cluster_tables(clusters.traits(means), means, str(tmp_path / "t"), blobs)
    assert spark.read.csv(str(tmp_path / "t/best_cluster_blobs"), header=True).count() == 3
