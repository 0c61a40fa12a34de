"""Readers and writers of tables: curves, mid-times, plasma, run logs; images as voxel tables."""

from __future__ import annotations

import gzip
import json
import struct
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def first_existing(spark: SparkSession, candidates: list[str]) -> str | None:
    """The first of the candidate paths that exists, on whatever file system."""
    for path in candidates:
        found = spark._jvm.org.apache.hadoop.fs.Path(path)
        if found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found):
            return path
    return None


def read_curves(spark: SparkSession, path: str, regions: list[str] | None = None, frames: int = 0, ignored: tuple[int, ...] = ()) -> DataFrame:
    """(frame, t, region, activity) from a wide table with a header, comma- or tab-separated as its second line says.

    The column MidTime, or the first without a name, holds mid-times. regions that are absent are left out.
    """
    head = spark.read.text(path).limit(2).collect()
    sep = max(("\t", ",", ";", " "), key=head[-1]["value"].count) if head else ","
    names = [n.strip() or "MidTime" for n in head[0]["value"].split(sep)] if head else []
    schema = ", ".join(f"`{n}` double" for n in names)
    wide = spark.read.schema(schema).csv(path, sep=sep, header=True)
    place = F.row_number().over(Window.orderBy("__at"))
    wide = wide.withColumn("__at", F.monotonically_increasing_id()).withColumn("frame", place).drop("__at")
    wide = wide if "MidTime" in names else wide.withColumn("MidTime", F.lit(None).cast("double"))
    if frames:
        wide = wide.where(F.col("frame") <= frames)
    wide = wide.where(~F.col("frame").isin(*ignored)) if ignored else wide
    keep = [n for n in names if n != "MidTime" and (regions is None or n in regions)]
    return wide.select("frame", F.col("MidTime").alias("t"), *keep).unpivot(["frame", "t"], keep, "region", "activity")


def read_mid_times(spark: SparkSession, path: str, ignored: tuple[int, ...] = (), latest: int = 0) -> DataFrame:
    """(frame, t, used) from a file with one number a line, or, if it is a .tsv, from the first column of a table with a header."""
    if path.endswith(".tsv"):
        head = spark.read.text(path).limit(1).collect()
        names = [f"c{i}" for i in range(len(head[0]["value"].split("\t")))] if head else ["c0"]
        rows = spark.read.schema(", ".join(f"{n} double" for n in names)).csv(path, sep="\t", header=True).select(F.col("c0").alias("t"))
    else:
        rows = spark.read.schema("t double").csv(path)
    rows = rows.withColumn("__at", F.monotonically_increasing_id())
    frame = F.row_number().over(Window.orderBy("__at"))  # some tens of lines
    used = ~F.col("frame").isin(*ignored) if ignored else F.lit(True)
    return rows.withColumn("frame", frame).withColumn("used", used & (F.lit(latest <= 0) | (F.col("frame") <= latest))).select("frame", "t", "used")


# The names of the columns of times and activities in files of plasma, the first that a file has, and the units whose
# activities such files give in parts of 1 / 37,000.
PLASMA_COLUMNS = (("PlasRawT", "PlasRawY"), ("time", "plasma_radioactivity"))
PLASMA_UNITS = ("Bq/mL", "Beq", "kBq")


def read_plasma(spark: SparkSession, path: str, sidecar: str | None = None) -> DataFrame | None:
    """(t, activity, time_units, activity_units) of a tab-separated file of plasma samples; None if it has no columns of known names.

    Units come from the sidecar, a JSON file with Units for each column, and are null without it. Activities in one of
    PLASMA_UNITS are divided by 37,000, whichever it is, as the original's are. Rows without a number are left out.
    """
    head = spark.read.text(path).limit(1).collect()
    names = [n.strip() for n in head[0]["value"].split("\t")] if head else []
    found = next((pair for pair in PLASMA_COLUMNS if set(pair) <= set(names)), None)
    if found is None:
        return None
    units = {}
    if sidecar:
        text = spark.read.text(sidecar, wholetext=True).first()[0]
        units = {name: entry.get("Units") for name, entry in json.loads(text).items() if isinstance(entry, dict)}
    rows = spark.read.schema(", ".join(f"`{n}` string" for n in names)).csv(path, sep="\t", header=True)
    t, activity = (F.col(f"`{n}`").try_cast("double") for n in found)
    scale = 37_000.0 if units.get(found[1]) in PLASMA_UNITS else 1.0
    out = rows.select(t.alias("t"), (activity / F.lit(scale)).alias("activity")).where("t IS NOT NULL AND activity IS NOT NULL")
    return out.withColumns({name: F.lit(units.get(column)).cast("string") for name, column in zip(("time_units", "activity_units"), found, strict=True)})


def log_values(lines: DataFrame, pattern: str, groups: dict[str, tuple[int, str]], text: str = "value") -> DataFrame:
    """lines that match the pattern, with a typed column for each of its groups."""
    return lines.where(F.col(text).rlike(pattern)).select("*", *[F.regexp_extract(text, pattern, i).cast(kind).alias(n) for n, (i, kind) in groups.items()])


def clip_threshold(lines: DataFrame, subjects: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, clip): the slices to clip that the newest log names (lines: keys, file, value; files sort by age), else 0."""
    found = log_values(lines, r"--axial-slices-to-clip (\d+)", {"clip": (1, "int")})
    newest = found.groupBy(*keys).agg(F.max_by("clip", "file").alias("clip"))
    return subjects.join(newest, keys, "left").select(*keys, F.coalesce("clip", F.lit(0)).alias("clip"))


# Fixed value: how a log names a cluster, and one that was taken in place of another.
_CLUSTER = r"centroid ([0-9]+)/([0-9]+): peak=([0-9.]+) @ t=([0-9]+)/([0-9]+), ([0-9]+) blobs w/~([0-9.]+) voxels"
_CLUSTER_FIELDS = (("label", "int"), ("k", "int"), ("peak", "double"), ("t", "int"), ("t_len", "int"), ("blobs", "int"), ("vox_per_blob", "double"))


def alternates_taken(lines: DataFrame, text: str = "value") -> DataFrame:
    """Log lines that say that an alternate was taken, with orig and final: structs of the clusters' seven typed fields, and step.

    The second clustering has four clusters, so step is 2 if the original's k is 4. Other lines are left out.
    """
    pattern = "alternate.*" + _CLUSTER + ".*" + _CLUSTER
    field = lambda i, name, kind: F.regexp_extract(text, pattern, i).cast(kind).alias(name)
    one = lambda start: F.struct(*[field(start + i, *f) for i, f in enumerate(_CLUSTER_FIELDS)])
    found = lines.where(F.col(text).rlike(pattern)).withColumns({"orig": one(1), "final": one(8)})
    return found.withColumn("step", F.when(F.col("orig.k") == 4, 2).otherwise(1))


def run_folders(paths: DataFrame) -> DataFrame:
    """paths (path, ...) with what a run's folder says of it: sr (sparsity reduction; 0 for nosr), clip, overridden."""
    part = lambda pattern: F.nullif(F.regexp_extract("path", pattern, 1), F.lit("")).cast("int")
    sr = F.when(F.col("path").contains("_nosr"), 0).otherwise(part(r"sr-(\d+)"))
    return paths.withColumns({"sr": sr, "clip": F.coalesce(part(r"clip-(\d+)"), F.lit(0)), "overridden": F.col("path").rlike("or-x")})


def decode_nifti(raw: bytes) -> tuple[tuple[int, ...], np.ndarray]:
    """(shape, values in the file's order) of a NIfTI-1 or Analyze file's bytes, plain or gzipped."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    order = "<" if struct.unpack_from("<i", raw, 0)[0] == 348 else ">"
    dims = struct.unpack_from(order + "8h", raw, 40)
    kind = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}[struct.unpack_from(order + "h", raw, 70)[0]]
    at, slope, inter = struct.unpack_from(order + "3f", raw, 108)
    shape = tuple(d for d in dims[1 : dims[0] + 1])
    values = np.frombuffer(raw, np.dtype(kind).newbyteorder(order), int(np.prod(shape)), int(max(at, 348)))
    values = values.astype(float)
    return shape, values * slope + inter if slope not in (0.0,) else values


def encode_nifti(values: np.ndarray) -> bytes:
    """A NIfTI-1 file of doubles with the array's shape (x, y, z or x, y, z, t)."""
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, values.ndim, *values.shape, *[1] * (7 - values.ndim))
    struct.pack_into("<2h", head, 70, 64, 64)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    head[344:348] = b"n+1\0"
    return bytes(head) + values.astype("<f8").tobytes(order="F")


def read_images(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, frame from 1, x, y, z, activity) of images: each file is decoded where it is read, one file a row of bytes.

    A 4-D file gives its own frames; of several 3-D files the last number in their names orders the frames, then the name.
    """
    files = spark.read.format("binaryFile").load(pattern).select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                shape, values = decode_nifti(bytes(content))
                cube = values.reshape((*shape, 1)[:4] if len(shape) == 3 else shape, order="F")
                for frame in range(cube.shape[3]):
                    x, y, z = np.indices(cube.shape[:3])
                    yield pd.DataFrame({"path": path, "at": frame, "x": x.ravel(), "y": y.ravel(), "z": z.ravel(), "activity": cube[..., frame].ravel()})

    cells = files.mapInPandas(decode, "path string, at int, x int, y int, z int, activity double")
    order = files.select("path").distinct()
    # One row a file: a scan has some tens.
    number = F.element_at(F.regexp_extract_all(F.regexp_replace("path", r"\.(nii|img|hdr)(\.gz)?$", ""), F.lit(r"(\d+)"), F.lit(1)), -1).cast("long")
    placed = order.withColumn("place", F.row_number().over(Window.orderBy(number, "path")) - 1)
    many = F.max("at").over(Window.partitionBy()) > 0
    sizes = cells.groupBy("path").agg(F.max("at").alias("at")).withColumn("many", many).select("path", "many")
    return cells.join(F.broadcast(placed), "path").join(F.broadcast(sizes), "path").select("path", (F.when(F.col("many"), F.col("at")).otherwise(F.col("place")) + 1).alias("frame"), "x", "y", "z", "activity")


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").csv(path, header=True, sep=sep)


def write_cluster_tables(found: DataFrame, centroid_curves: DataFrame, path: str, best_blobs: DataFrame | None = None) -> None:
    """Under path: metadata (a row a cluster, doubles to 5 places) and tacs (a row a frame, a column l-label_k-k a cluster), as CSV;
    and the blobs of the best cluster, best_cluster_blobs, if they are given."""
    if best_blobs is not None:
        write_csv(best_blobs, f"{path}/best_cluster_blobs")
    rounded = [F.round(c, 5).alias(c) if kind == "double" else F.col(c) for c, kind in found.dtypes]
    write_csv(found.select(*rounded).orderBy("k", "label"), f"{path}/metadata")
    names = found.select("k", "label").distinct().orderBy("k", "label").collect()  # a row a cluster: columns of the table
    name = F.format_string("l-%d_k-%d", "label", "k")
    wide = centroid_curves.withColumn("name", name).groupBy("frame").pivot("name", [f"l-{r['label']}_k-{r['k']}" for r in names]).agg(F.first("activity"))
    write_csv(wide.orderBy("frame"), f"{path}/tacs")


def write_matrix(similar: DataFrame, path: str) -> None:
    """The square Dice matrix (k1, label1, k2, label2, dice) as CSV: rows and columns are clusters; no shared voxel gives 0."""
    names = [r["name"] for r in similar.select(F.format_string("%02d-%02d", "label1", "k1").alias("name")).distinct().orderBy("name").collect()]
    rows = similar.select(F.format_string("%02d-%02d", "label1", "k1").alias("cluster"), F.format_string("%02d-%02d", "label2", "k2").alias("name"), "dice")
    write_csv(rows.groupBy("cluster").pivot("name", names).agg(F.first("dice")).fillna(0.0).orderBy("cluster"), path)


def write_masks(masks: DataFrame, path: str, again: bool = False) -> None:
    """masks (bucket, k, label, x, y, z): a folder a bucket and cluster; left alone if it exists, unless again."""
    masks.write.mode("overwrite" if again else "ignore").partitionBy("bucket", "k", "label").parquet(path)


def write_components(scores: DataFrame, stats: DataFrame, cells: DataFrame, path: str, again: bool = False) -> None:
    """Under path: stats (CSV) and maps, a folder of Parquet (x, y, z, score) for each algorithm, components and component.

    scores: (algorithm, components, vox_id, component, score); cells: (vox_id, x, y, z). Maps are left alone if they exist,
    unless again.
    """
    by = ["algorithm", "components", "component"]
    write_csv(stats.orderBy(*by), f"{path}/stats")
    maps = scores.join(cells.select("vox_id", *"xyz"), "vox_id").select(*by, *"xyz", "score")
    maps.write.mode("overwrite" if again else "ignore").partitionBy(*by).parquet(f"{path}/maps")


def write_frames(voxels: DataFrame, path: str, again: bool = False) -> None:
    """A folder of Parquet for each frame; left alone if it exists, unless again."""
    voxels.write.mode("overwrite" if again else "ignore").partitionBy("frame").parquet(path)


def cached(spark: SparkSession, path: str, make, force: bool = False, **config) -> DataFrame:
    """The table made with config, kept under path in a folder that the config names; made first if it is absent or force is given.

    A table counts once its write has ended (Spark's _SUCCESS), so what a failed job has left is written over.
    """
    if config:
        path = f"{path}/{sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]}"
    if force or not first_existing(spark, [f"{path}/_SUCCESS"]):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
