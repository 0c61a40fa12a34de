"""Image files, partial volumes, checks of inputs, components and failures against plain versions."""

import gzip
import struct
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinespark.operators import components, kinetics, partial_volume, resample, tracer
from kinespark.plans import stage_queries
from kinespark.sources import inputs, nifti

AFFINE = [1.5, 0.0, 0.0, -3.0, 0.0, 2.0, 0.0, 1.0, 0.0, 0.0, -2.5, 7.0]
ROWS = tuple(tuple(AFFINE[i : i + 4]) for i in (0, 4, 8))


def cube_of(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["x"], r["y"], r["z"], r["frame"] - 1] = r["activity"]
    return out


def file_of(cube, kind="<f8", slope=0.0, inter=0.0):
    order = kind[0]
    head = bytearray(nifti.build_header(cube.shape, ROWS))
    if order == ">":
        head = bytearray(352)
        struct.pack_into(">i", head, 0, 348)
        struct.pack_into(">8h", head, 40, cube.ndim, *cube.shape, *[1] * (7 - cube.ndim))
        struct.pack_into(">8f", head, 76, 1.0, 1.5, 2.0, 2.5, 1, 0, 0, 0)
        struct.pack_into(">f", head, 108, 352.0)
        head[344:348] = b"n+1\0"
    code = next(c for c, k in nifti.KINDS.items() if k == kind[1:])
    struct.pack_into(order + "h", head, 70, code)
    struct.pack_into(order + "2f", head, 112, slope, inter)
    return bytes(head) + cube.astype(kind).tobytes(order="F")


@pytest.fixture(scope="module")
def scan():
    return np.random.default_rng(5).integers(-300, 300, (5, 4, 6, 7)).astype(float)


@pytest.mark.parametrize("kind, slope, inter", [("<f8", 0, 0), ("<i2", 0.5, 3.0), (">i2", 0, 0), ("<f4", 2.0, 0.0)])
def test_one_file_of_many_frames(spark, tmp_path, scan, kind, slope, inter):
    (tmp_path / "scan.nii").write_bytes(file_of(scan, kind, slope, inter))
    (tmp_path / "zipped.nii.gz").write_bytes(gzip.compress(file_of(scan, kind, slope, inter)))
    want = scan * (slope or 1) + (inter if slope else 0)
    for name in ("scan.nii", "zipped.nii.gz"):
        rows = nifti.read_scan(spark, str(tmp_path / name), late=5, ignored=(2, 6))
        assert (cube_of(rows, scan.shape) == want).all()
        assert {(r["frame"], r["use"]) for r in rows.select("frame", "use").distinct().collect()} == {(1, "used"), (2, "ignored"), (3, "used"), (4, "used"), (5, "used"), (6, "ignored"), (7, "late")}


def test_slabs_and_frames_that_are_read(spark, tmp_path, scan):
    path = tmp_path / "scan.nii"
    path.write_bytes(file_of(scan))
    nifti.register(spark)
    small = spark.read.format("imagescan").option("slabbytes", 5 * 4 * 8 * 2).load(str(path))
    assert small.rdd.getNumPartitions() == 3 * 7 and (cube_of(small, scan.shape) == scan).all()
    some = nifti.read_scan(spark, str(path), first=3, last=4)
    assert some.rdd.getNumPartitions() == 2 and {r["frame"] for r in some.select("frame").distinct().collect()} == {3, 4}
    # Only the bytes of these frames are read: the file may end after them.
    volume = 5 * 4 * 6 * 8
    path.write_bytes(file_of(scan)[: 352 + 4 * volume])
    assert nifti.read_scan(spark, str(path), first=3, last=4).count() == 2 * 120
    with pytest.raises(Exception, match="ends before its frame 5"):
        nifti.read_scan(spark, str(path), first=5, last=5).count()
    with pytest.raises(Exception, match="no image at"):
        nifti.read_scan(spark, str(tmp_path / "none*.nii")).count()


def test_ten_files_and_an_analyze_pair(spark, tmp_path, scan):
    for frame in (10, 9, 2, 1, 7, 3):
        (tmp_path / f"sub.{frame}.x.nii").write_bytes(file_of(scan[..., frame % 7]))
    found = cube_of(nifti.read_scan(spark, str(tmp_path / "sub.*.nii")), (*scan.shape[:3], 6))
    assert (found == np.stack([scan[..., f % 7] for f in (1, 2, 3, 7, 9, 10)], 3)).all()
    raw = file_of(scan[..., 0], ">i2")
    head = bytearray(raw[:348])
    head[344:348] = b"\0\0\0\0"
    pair = tmp_path / "pair"
    pair.mkdir()
    (pair / "old.hdr").write_bytes(head)
    (pair / "old.img").write_bytes(raw[352:])
    assert (cube_of(nifti.read_scan(spark, str(pair / "old.img")), (*scan.shape[:3], 1))[..., 0] == scan[..., 0]).all()
    assert nifti.headers(spark, str(pair)).first()["affine"] == [1.5, 0, 0, 0, 0, 2.0, 0, 0, 0, 0, 2.5, 0]


def test_a_scan_is_written_whole_or_not_at_all(spark, tmp_path, scan):
    (tmp_path / "scan.nii").write_bytes(file_of(scan))
    rows = nifti.read_scan(spark, str(tmp_path / "scan.nii"))
    out = tmp_path / "out"
    nifti.write_scan(rows.where("activity <> 7"), str(out), scan.shape[:3], AFFINE)
    assert sorted(p.name for p in out.iterdir()) == ["_SUCCESS", *[f"frame_{i:05d}.nii" for i in range(1, 8)]]
    assert (cube_of(nifti.read_scan(spark, str(out)), scan.shape) == np.where(scan == 7, 0, scan)).all()
    bad = rows.withColumn("x", F.when(F.col("frame") == 7, 99).otherwise(F.col("x")))
    with pytest.raises(Exception):
        nifti.write_scan(bad, str(out), scan.shape[:3], AFFINE)
    assert not [p for p in out.iterdir() if p.name.startswith("_attempt")]
    assert (cube_of(nifti.read_scan(spark, str(out)), scan.shape) == np.where(scan == 7, 0, scan)).all()
    nifti.write_scan(rows.where("frame <= 2"), str(out), scan.shape[:3], AFFINE)
    assert nifti.read_scan(spark, str(out)).agg(F.max("frame")).first()[0] == 2
    other = bytearray(file_of(scan[..., 0]))
    struct.pack_into("<f", other, 280, 9.0)
    (out / "frame_00003.nii").write_bytes(other)
    best = nifti.majority_affine(nifti.headers(spark, str(out))).first()
    assert (best["affine"], best["files"]) == (AFFINE, 2)


def dense_blur(cube, sigma):
    for axis, s in enumerate(sigma):
        k = partial_volume.kernel(s)
        cube = np.apply_along_axis(lambda v: np.convolve(np.pad(v, len(k) // 2), k, "valid"), axis, cube)
    return cube


@pytest.mark.parametrize("block", [3, 32])
def test_smoothing_and_correction(spark, block):
    rng, shape, sigma = np.random.default_rng(3), (9, 7, 11), (0.6, 1.1, 0.8)
    cube = rng.random((*shape, 2))
    place = np.argwhere(np.ones(shape))
    rows = [(f + 1, *map(int, p), float(cube[(*p, f)])) for p in place for f in range(2)]
    cells = spark.createDataFrame(rows, "frame int, x int, y int, z int, activity double")
    got = cube_of(partial_volume.smoothed(cells, shape, sigma, keys=["frame"], block=block), cube.shape)
    assert np.allclose(got, np.stack([dense_blur(cube[..., f], sigma) for f in range(2)], 3))
    inside = np.zeros(shape)
    inside[2:6, 1:5, 3:8] = 1
    mask = spark.createDataFrame([tuple(map(int, p)) for p in np.argwhere(inside)], "x int, y int, z int")
    # A region of one activity amid another, blurred, is given back.
    true = np.where(inside > 0, 8.0, 2.0)
    blurred = dense_blur(true, sigma)
    measured = spark.createDataFrame([(1, *map(int, p), float(blurred[tuple(p)])) for p in place], "frame int, x int, y int, z int, activity double")
    fixed = partial_volume.corrected(measured, mask, shape, sigma)
    want = (blurred - dense_blur(blurred * (1 - inside), sigma)) / dense_blur(inside, sigma)
    assert {(r["x"], r["y"], r["z"]): pytest.approx(r["activity"]) for r in fixed.collect()} == {tuple(map(int, p)): want[tuple(p)] for p in np.argwhere(inside)}
    assert abs(want[inside > 0].mean() - 8) < 0.3 * abs(blurred[inside > 0].mean() - 8)
    assert partial_volume.region_curve(fixed).count() == 2  # one frame, which is the peak, and a zero before it
    assert partial_volume.corrected(measured, mask.limit(0), shape, sigma).count() == 0
    assert partial_volume.deviations(resample.Grid(shape, ROWS), 2.3548) == pytest.approx((1 / 1.5, 0.5, 0.4), rel=1e-4)


def test_sources_and_checks(spark):
    files = [("a", "cached", "c"), ("a", "named", "n"), ("b", "volumes", "v2"), ("b", "volumes", "v1"), ("c", "volumes", "v"), ("d", "matched", "m1"), ("d", "matched", "m2"), ("d", "named", "n"), ("e", "other", "o"), (None, "named", "n"), ("f", "named", None), ("a", "cached", "c")]
    got = inputs.image_source(spark.createDataFrame(files, "subject string, kind string, path string")).collect()
    assert sorted(map(tuple, got)) == [("a", "named", "n", 1), ("b", "volumes", "v1", 2), ("c", "volumes", "v", 1), ("d", "matched", "m2", 1)]
    units = inputs.used_units(spark.createDataFrame([("a", "kBq", "Bq/mL"), ("b", "", "Bq/mL"), ("c", None, None), ("d", "kBq", "kBq"), ("e", "kBq", None)], "subject string, option string, sidecar string"))
    assert {r["subject"]: (r["units"], r["conflict"]) for r in units.collect()} == {"a": ("kBq", True), "b": ("Bq/mL", False), "c": (None, False), "d": ("kBq", False), "e": ("kBq", False)}
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    subjects = make([("a",), ("b",)], "subject string")
    frames = make([("a", True), ("a", False), ("b", True)], "subject string, used boolean")
    times = make([("a", True), ("b", True), ("b", None)], "subject string, used boolean")
    regions = make([("a", "x"), ("a", "y")], "subject string, region string")
    good = inputs.failed_checks(subjects, subjects, times, frames, regions, regions, units.where("subject = 'd'"))
    assert good.count() == 0
    inputs.refuse(good)
    bad = inputs.failed_checks(subjects, subjects.limit(0), times.unionByName(times), frames, regions, regions.where("region = 'x'"), units)
    assert sorted((r["subject"], r["what"], r["fatal"]) for r in bad.collect()) == [("a", "frames and times differ", True), ("a", "no curves", True), ("a", "no such region", False), ("a", "units differ", False), ("b", "frames and times differ", True), ("b", "no curves", True)]
    with pytest.raises(ValueError, match=r"a: frames and times differ \(1 and 2\); a: no curves; b: "):
        inputs.refuse(bad)


def test_weights_of_a_draw(spark):
    rows = spark.range(20_000).withColumn("w", kinetics.resample_weights(F.col("id"), 3)).withColumn("v", kinetics.resample_weights(F.col("id"), 4))
    r = rows.agg(F.avg("w").alias("m"), F.var_pop("w").alias("s"), F.corr("w", "v").alias("c")).first()
    assert abs(r["m"] - 1) < 0.03 and abs(r["s"] - 1) < 0.06 and abs(r["c"]) < 0.03
    assert rows.where("w = 0").count() / 20_000 == pytest.approx(np.exp(-1), abs=0.015)
    values = spark.createDataFrame([("a", float(i), 1) for i in range(100)] + [("a", 5.0, 0), ("b", 2.0, 3), ("c", None, 1)], "k string, v double, w int")
    got = {(r["k"], r["bin"]): r["n"] for r in kinetics.resampled_density(values, ["k"], "v", "w", 10).collect()}
    assert got == {("b", 0): 3} | {("a", i): 10 for i in range(10)}


def test_brain_component(spark):
    rng = np.random.default_rng(2)
    place = [(i, i % 10, i // 10 % 10, i // 100) for i in range(1000)]
    ball = [i for i, x, y, z in place if (x - 5) ** 2 + (y - 5) ** 2 + (z - 5) ** 2 <= 3]
    scores = [("p", i, c, 5.0 if c == 2 and i in ball else float(rng.random())) for i in range(1000) for c in (1, 2, 3)]
    cells = spark.createDataFrame(place, "vox_id long, x long, y long, z long")
    found = components.containment(spark.createDataFrame(scores, "algorithm string, vox_id long, component long, score double"), cells, ["algorithm"])
    ratio = {r["component"]: (r["n"], r["ratio"]) for r in found.collect()}
    assert ratio[1][0] == ratio[2][0] == 50 and ratio[2][1] > ratio[1][1]
    (best,) = components.brain_component(found, ["algorithm"], (ratio[2][1] + max(ratio[1][1], ratio[3][1])) / 2).collect()
    assert best["component"] == 2
    assert components.brain_component(found, ["algorithm"], 1.0).count() == 0


def test_failures_with_their_parameters(spark, sf, tmp_path):
    args = stage_queries._vessel(spark, sf).select("t", "activity", "sd", "sigma"), stage_queries._tissues(spark, sf)
    each = tracer.bootstrap(*args, n=8, step=stage_queries.STEP, each_failure=True).cache()
    counted = tracer.bootstrap(*args, n=8, step=stage_queries.STEP).where("code > 0").groupBy("copy", "code").agg(F.sum("n").alias("n"))
    records = tracer.failure_records(each)
    for _ in range(2):
        tracer.append_failures(records, str(tmp_path / "failures"))
    kept = spark.read.parquet(str(tmp_path / "failures"))
    assert {p.name for p in Path(tmp_path / "failures").iterdir() if p.name.startswith("code")} == {f"code={r['code']}" for r in records.select("code").distinct().collect()}
    want = {(r["copy"], r["code"]): r["n"] for r in counted.collect()}
    assert {(r["copy"], r["code"]): r["count"] for r in records.groupBy("copy", "code").count().collect()} == want and want
    summary = {(r["code"], r["place"]): r for r in tracer.failure_summary(kept).collect()}
    for code in {c for _, c in want}:
        assert summary[code, 0]["n"] == 2 * sum(n for (_, c), n in want.items() if c == code)
    assert all(r["parameters"] and r["reason"] for r in records.collect())
    assert set(tracer.FAILURES) >= {21, 31}
    each.unpersist()
