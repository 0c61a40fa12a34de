"""Readers of plasma and mid-times, sinks of frames, and places of voxels in a matrix."""

import json

import numpy as np
from pyspark.sql import functions as F

from kinespark.operators import lattice
from kinespark.sources import tables


def test_plasma(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("time\tother\tplasma_radioactivity\n0.5\tx\t37000\n1.5\ty\tn/a\n2.5\tz\t74000\n")
    (tmp_path / "a.json").write_text(json.dumps({"time": {"Units": "min"}, "plasma_radioactivity": {"Units": "kBq"}, "Note": "text"}, indent=1))
    (tmp_path / "b.tsv").write_text("PlasRawT\tPlasRawY\ttime\n1\t2\t3\n")
    (tmp_path / "c.tsv").write_text("t\ty\n1\t2\n")
    (tmp_path / "d.tsv").write_text("")
    read = lambda name, *more: tables.read_plasma(spark, str(tmp_path / name), *more)
    assert sorted(map(tuple, read("a.tsv", str(tmp_path / "a.json")).collect())) == [(0.5, 1.0, "min", "kBq"), (2.5, 2.0, "min", "kBq")]
    assert sorted(map(tuple, read("a.tsv").collect())) == [(0.5, 37000.0, None, None), (2.5, 74000.0, None, None)]
    assert list(map(tuple, read("b.tsv").collect())) == [(1.0, 2.0, None, None)]
    assert read("c.tsv") is None and read("d.tsv") is None


def test_mid_times(spark, tmp_path):
    (tmp_path / "midtimes.txt").write_text("0.25\n0.75\n1.5\n3\n")
    got = tables.read_mid_times(spark, str(tmp_path / "midtimes.txt"), ignored=(2,), latest=3).orderBy("frame").collect()
    assert list(map(tuple, got)) == [(1, 0.25, True), (2, 0.75, False), (3, 1.5, True), (4, 3.0, False)]
    assert tables.read_mid_times(spark, str(tmp_path / "midtimes.txt")).where("used").count() == 4


def test_frames_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([(f, x, 0, 0, float(f * x)) for f in (1, 2) for x in range(3)], "frame int, x int, y int, z int, activity double")
    path = str(tmp_path / "frames")
    tables.write_frames(rows, path)
    tables.write_frames(rows.withColumn("activity", F.lit(9.0)), path)
    back = spark.read.parquet(path)
    assert sorted((r["frame"], r["x"], r["activity"]) for r in back.collect()) == [(f, x, float(f * x)) for f in (1, 2) for x in range(3)]
    assert {p.name for p in (tmp_path / "frames").iterdir() if p.name.startswith("frame")} == {"frame=1", "frame=2"}
    tables.write_frames(rows.withColumn("activity", F.lit(9.0)), path, again=True)
    assert spark.read.parquet(path).where("activity = 9").count() == 6


def test_places_in_the_matrix(spark):
    cube = np.arange(3 * 4 * 5).reshape(3, 4, 5)
    flat = np.moveaxis(cube, 2, 0).ravel()  # slices outermost, then x, then y
    rows = spark.createDataFrame([(int(x), int(y), int(z), int(cube[x, y, z])) for x, y, z in np.ndindex(cube.shape)], "x int, y int, z int, value int")
    placed = rows.withColumn("vox_id", lattice.voxel_id(F.col("x"), F.col("y"), F.col("z"), 3, 4))
    assert {r["vox_id"]: r["value"] for r in placed.collect()} == dict(enumerate(flat.tolist()))
    x, y, z = lattice.voxel_xyz(F.col("vox_id"), 3, 4)
    assert placed.where((x != F.col("x")) | (y != F.col("y")) | (z != F.col("z"))).count() == 0
