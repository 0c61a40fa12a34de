"""Choice of inputs, sinks and the small functions of summaries, on small tables."""

import csv
from glob import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinespark.functions import curves
from kinespark.operators import clusters, components, kinetics
from kinespark.sources import inputs, tables


def test_the_first_place_with_a_file_wins(spark):
    files = [
        ("a", "tacs.txt"), ("a", "raw/sub-a.tacs.tsv"), ("a", "raw/sub-a.tacs.tsv"), ("a", "raw/sub-b.tacs.tsv"),
        ("b", "ses-fdg2_tacs/out_file/wmparc_reoriented_tacs.tsv"), ("b", "ses-fdg1_tacs/out_file/wmparc_reoriented_tacs.tsv"), ("b", "b.TACs"),
        ("c", "notes.txt"), ("d", None), (None, "tacs.txt"), ("e", "ses-fdg/x_tacs/out_file/wmparc_reoriented_tacs.tsv"), ("e", "_tacs/out_file/wmparc_reoriented_tacs.tsv"),
    ]
    rows = spark.createDataFrame(files, "subject string, path string")
    found = {r["subject"]: tuple(r)[1:] for r in inputs.resolve(rows, "tacs", "FDG").where("subject IS NOT NULL").collect()}
    assert found == {"a": ("raw/sub-a.tacs.tsv", 1, 1), "b": ("ses-fdg1_tacs/out_file/wmparc_reoriented_tacs.tsv", 0, 2)}
    lost = inputs.missing(rows, inputs.resolve(rows, "tacs", "FDG"), ["subject"])
    assert {r["subject"] for r in lost.where("subject IS NOT NULL").collect()} == {"c", "d", "e"}
    assert inputs.resolve(rows.where("false"), "plasma").count() == 0


@pytest.mark.parametrize("kind", sorted(inputs.PLACES))
def test_every_place_is_found(spark, kind):
    paths = [(i, p.replace("{id}", "7").replace("{tracer}", "fdg").replace("*", "-x")) for i, p in enumerate(inputs.PLACES[kind])]
    rows = spark.createDataFrame(paths, "i int, path string")
    at = rows.select("i", inputs.place_of(kind, F.lit("7"), F.col("path"), "FDG").alias("place")).collect()
    assert [r["place"] for r in at] == [r["i"] for r in at]


def test_newest(spark):
    rows = spark.createDataFrame([(1, "log-2024"), (1, "log-2025"), (2, "log-1")], "s int, path string")
    assert sorted(tuple(r) for r in inputs.newest(rows, ["s"]).collect()) == [(1, "log-2025", 1), (2, "log-1", 0)]


def test_masks_read_and_written(spark, tmp_path):
    cube = np.zeros((3, 2, 2))
    cube[2, 1, 0] = cube[0, 0, 1] = 1
    (tmp_path / "mask.nii").write_bytes(tables.encode_nifti(cube))
    cells = inputs.read_mask(spark, str(tmp_path / "mask.nii"))
    assert {(r["x"], r["y"], r["z"]) for r in cells.collect()} == {(2, 1, 0), (0, 0, 1)}
    masks = cells.select(F.lit("vascular").alias("bucket"), F.lit(6).alias("k"), F.lit(1).alias("label"), "x", "y", "z")
    out = str(tmp_path / "masks")
    tables.write_masks(masks, out)
    tables.write_masks(masks.where("x = 0"), out)
    assert spark.read.parquet(f"{out}/bucket=vascular/k=6/label=1").count() == 2
    tables.write_masks(masks.where("x = 0"), out, again=True)
    assert spark.read.parquet(out).count() == 1


def _csv(folder):
    return [r for path in sorted(glob(f"{folder}/part-*")) for r in csv.DictReader(open(path))]


def test_cluster_tables(spark, tmp_path):
    rows = spark.createDataFrame([(6, 1, f, f / 3, 4) for f in (1, 2, 3)] + [(6, 2, f, 1.0, 5) for f in (1, 2, 3)], "k int, label int, frame long, activity double, voxel_count long")
    tables.write_cluster_tables(clusters.traits(rows), rows, str(tmp_path / "out"))
    found = _csv(tmp_path / "out" / "metadata")
    assert [(r["k"], r["label"], r["peak_value"]) for r in found] == [("6", "1", "1.0"), ("6", "2", "1.0")]
    wide = _csv(tmp_path / "out" / "tacs")
    assert [r["frame"] for r in wide] == ["1", "2", "3"] and [float(r["l-1_k-6"]) for r in wide] == pytest.approx([1 / 3, 2 / 3, 1]) and wide[0]["l-2_k-6"] == "1.0"


def test_matrix_is_square(spark, tmp_path):
    labels = spark.createDataFrame([(6, 1, v) for v in range(4)] + [(10, 1, v) for v in range(2)] + [(10, 2, v) for v in (2, 3)], "k int, label int, vox_id long")
    tables.write_matrix(clusters.dice(labels), str(tmp_path / "dice"))
    found = _csv(tmp_path / "dice")
    names = ["01-06", "01-10", "02-10"]
    assert [r["cluster"] for r in found] == names
    assert [[float(r[n]) for n in names] for r in found] == pytest.approx(np.array([[1, 2 / 3, 2 / 3], [2 / 3, 1, 0], [2 / 3, 0, 1]]))


def test_monotone_cubic_at_any_times(spark):
    knots = [(1, t, 2 * t + 1) for t in (0.0, 1.0, 3.0, 4.0)] + [(2, 5.0, 7.0)] + [(3, t, y) for t, y in ((0.0, 0.0), (1.0, 1.0), (2.0, 1.0), (3.0, 5.0))]
    rows = spark.createDataFrame(knots, "c int, t double, activity double")
    grid = spark.createDataFrame([(c, t) for c in (1, 2, 3, 4) for t in (-0.5, 0.0, 0.3, 1.0, 1.5, 2.7, 3.0, 4.2)], "c int, t double")
    found = {(r["c"], r["t"]): r["activity"] for r in curves.pchip_at(rows, grid, ["c"]).collect()}
    assert len(found) == 32
    assert [found[1, t] for t in (-0.5, 0.3, 1.0, 2.7, 4.2)] == pytest.approx([0, 1.6, 3, 6.4, 9.4])
    assert {found[2, t] for t in (-0.5, 4.2)} == {7.0} and found[4, 1.0] is None
    assert found[3, 1.5] == pytest.approx(1) and found[3, 3.0] == pytest.approx(5) and 1 < found[3, 2.7] < 5
    halves = {r["t"]: r["activity"] for r in curves.pchip(rows.where("c = 3"), ["c"]).collect()}
    again = curves.pchip_at(rows, spark.createDataFrame([(3, t) for t in halves], "c int, t double"), ["c"]).collect()
    assert {r["t"]: r["activity"] for r in again} == pytest.approx(halves)


def test_equation_has_the_largest_first_and_ties_in_order(spark):
    terms = "array(struct(1.5D AS c, 0.1D AS rate), struct(7D AS c, 0.25D AS rate), struct(1.5D AS c, 0.9D AS rate))"
    found = spark.sql(f"SELECT {terms} AS terms").select(kinetics.equation(F.col("terms")).alias("e")).first()["e"]
    assert found == "7.00e^{-0.25t} + 1.50e^{-0.10t} + 1.50e^{-0.90t}"


def test_log_of_alternates(spark):
    one = "centroid 3/10: peak=4.5 @ t=7/26, 12 blobs w/~8.25 voxels"
    lines = [f"INFO alternate: {one} is {one.replace('3/10', '5/14')}", f"alternate {one.replace('/10', '/4')} then {one}", one, "", None]
    rows = spark.createDataFrame([(line,) for line in lines], "value string")
    found = sorted(tables.alternates_taken(rows).collect(), key=lambda r: r["step"])
    assert [(r["step"], r["orig"]["k"], r["final"]["k"]) for r in found] == [(1, 10, 14), (2, 4, 10)]
    assert tuple(found[0]["orig"]) == (3, 10, 4.5, 7, 26, 12, 8.25)


def test_lines_limits_and_runners_up(spark):
    rows = spark.createDataFrame([(1, f, float(f), y) for f, y in ((1, 9.0), (2, 1.0), (3, 2.0))] + [(2, 1, 1.0, 3.0)], "c int, frame int, t double, activity double")
    found = {r["c"]: (r["rising"], r["rising_later"]) for r in curves.rising(curves.lines(rows, ["c"])).collect()}
    assert found == {1: (False, True), 2: (False, False)}
    units = spark.createDataFrame([("s",), ("Seconds",), ("min",)], "u string").select(curves.early_limit(F.col("u")).alias("x"))
    assert [r["x"] for r in units.collect()] == [600, 600, 10]
    made = spark.createDataFrame([(6, i, p, v, True) for i, p, v in ((1, 4, 9.0), (2, 5, 3.0), (3, 5, 8.0), (4, 6, 1.0), (5, 9, 7.0))], "k int, label int, peak_index int, peak_value double, vascular boolean")
    later = clusters.runners_up(made, made.where("label = 1")).orderBy("offset", "place").collect()
    assert [(r["offset"], r["place"], r["label"]) for r in later] == [(1, 1, 3), (1, 2, 2), (2, 1, 4)]


def test_component_stats(spark):
    rows = spark.createDataFrame([(v, c, float(v * c)) for v in (1, 2, 3) for c in (1, 2)], "vox_id int, component int, score double")
    found = {r["component"]: tuple(r)[1:] for r in components.component_stats(rows).collect()}
    assert found[2] == pytest.approx((3, 4, np.std([2, 4, 6]), 2, 6))
