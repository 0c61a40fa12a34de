"""Which of a scan's files are read, and what was asked for but isn't there. Listings of files are tables: (subject, path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespark.sources import tables

# The places of each kind of file within a subject's folder, in the order in which they are tried. {id} is the
# subject, {tracer} the tracer in lower case, * any characters but a slash.
PLACES = {
    "tacs": (
        "ses-{tracer}*_tacs/out_file/wmparc_reoriented_tacs.tsv",
        "raw/sub-{id}.tacs.tsv",
        "raw/{id}.tacs.tsv",
        "sub-{id}.TACs",
        "{id}.TACs",
        "sub-{id}_FS_TACs.csv",
        "{id}_FS_TACs.csv",
        "tacs.txt",
        "BS_Stats/coreg/{id}",
        "sub-{id}_tacs.tsv",
        "{id}_tacs.tsv",
    ),
    "plasma": (
        "raw/sub-{id}.plasma.tsv",
        "raw/{id}.plasma.tsv",
        "sub-{id}plasma.txt",
        "{id}plasma.txt",
        "plasma.txt",
        "{id}_plasma.tsv",
        "sub-{id}_plasma.tsv",
    ),
    "midtimes": (
        "raw/sub-{id}.raw.midtime.txt",
        "raw/{id}.raw.midtime.txt",
        "sub-{id}.raw.midtime.txt",
        "{id}.raw.midtime.txt",
        "midtimes.txt",
        "raw/midtimes.txt",
        "ses-{tracer}*_tacs/out_file/wmparc_reoriented_tacs.tsv",
    ),
}


def _is_at(place: str, subject: Column, path: Column, tracer: str) -> Column:
    """Whether path is the place, its id being subject's; a * matches within one folder."""
    filled = place.replace("{tracer}", tracer.lower())
    if "*" in filled:
        head, tail = filled.split("*")
        middle = F.substring(path, F.lit(len(head) + 1), F.greatest(F.length(path) - len(head) - len(tail), F.lit(0)))
        long_enough = F.length(path) >= len(head) + len(tail)
        return long_enough & path.startswith(head) & path.endswith(tail) & ~middle.contains("/")
    parts = filled.split("{id}")
    whole = [F.lit(parts[0])]
    for part in parts[1:]:
        whole += [subject, F.lit(part)]
    return path == F.concat(*whole)


def place_of(kind: str, subject: Column, path: Column, tracer: str = "") -> Column:
    """The number from 0 of the place that path is at; null if it is at none."""
    cases = [F.when(_is_at(p, subject, path, tracer), i) for i, p in enumerate(PLACES[kind])]
    return F.coalesce(*cases)


def resolve(files: DataFrame, kind: str, tracer: str = "") -> DataFrame:
    """(subject, path, place, ignored): of each subject's files (subject, path) the one that is read, and how many others are ignored.

    The first place that has a file wins; of several files at one place the first by name. Subjects without any such file have
    no row (missing gives them). A listing that has a file twice counts it once; rows with a null are no files.
    """
    at = files.withColumn("place", place_of(kind, F.col("subject"), F.col("path"), tracer)).where("place IS NOT NULL")
    best = F.min(F.struct("place", "path")).alias("best")
    found = at.select("subject", "path", "place").distinct().groupBy("subject").agg(best, (F.count("*") - 1).alias("ignored"))
    return found.select("subject", "best.path", "best.place", "ignored")


def files_of(spark: SparkSession, folder: str, subject: str, kind: str, tracer: str = "") -> list[str]:
    """The files of a kind that stand in the subject's folder, on whatever file system: the first is the one that is read."""
    found = []
    for place in PLACES[kind]:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{place.replace('{tracer}', tracer.lower()).replace('{id}', subject)}")
        for status in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []:
            if status.isFile():
                found.append(status.getPath().toString())
    return found


def read(spark: SparkSession, folder: str, subject: str, kind: str, tracer: str = "", **options) -> tuple[DataFrame | None, list[str]]:
    """(table, files): what the first of files_of holds, read as its kind is, and all of them; the others are ignored.

    tacs are read by tables.read_curves, plasma by tables.read_plasma, midtimes by tables.read_mid_times; options go there.
    No file gives None. Kinds other than those of PLACES are an error.
    """
    if kind not in PLACES:
        raise ValueError(f"{kind} is none of {', '.join(PLACES)}")
    files = files_of(spark, folder, subject, kind, tracer)
    reader = {"tacs": tables.read_curves, "plasma": tables.read_plasma, "midtimes": tables.read_mid_times}[kind]
    return (reader(spark, files[0], **options) if files else None), files


def missing(asked: DataFrame, given: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of asked, once each, whose keys given doesn't have: regions that a table lacks, subjects without a file."""
    return asked.select(*keys).distinct().join(given.select(*keys), keys, "left_anti")


def newest(files: DataFrame, keys: list[str], by: str = "path") -> DataFrame:
    """Of each key's files the last by name, as run folders and logs are dated; others counts the rest."""
    return files.groupBy(*keys).agg(F.max(by).alias(by), (F.count("*") - 1).alias("others"))


def read_mask(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, x, y, z): the voxels that are not 0 in the masks under pattern."""
    return tables.read_images(spark, pattern).where("activity <> 0").select("path", "x", "y", "z")


# The kinds of image sources, the one that is used first. A pattern's match comes before a file that was named, that before
# the image of an earlier run, that before a folder of volumes.
SOURCES = ("matched", "named", "cached", "volumes")


def image_source(found: DataFrame) -> DataFrame:
    """(subject, kind, path, files): of each subject's image files (subject, kind of SOURCES, path) the source that is read.

    Of several matches the last by name is read. Volumes are a source together, path being the first by name, and a single
    volume is one, too. Other kinds, and rows with a null, are no sources; files that a listing has twice count once.
    """
    place = F.coalesce(*[F.when(F.col("kind") == kind, i) for i, kind in enumerate(SOURCES)])
    known = found.select("subject", "kind", "path", place.alias("place")).where("place IS NOT NULL AND path IS NOT NULL AND subject IS NOT NULL").distinct()
    by = known.groupBy("subject", "place", "kind").agg(F.max("path").alias("last"), F.min("path").alias("first"), F.count("*").alias("files"))
    path = F.when(F.col("kind") == "volumes", F.col("first")).otherwise(F.col("last"))
    best = by.groupBy("subject").agg(F.min_by(F.struct("kind", path.alias("path"), F.when(F.col("kind") == "volumes", F.col("files")).otherwise(1).cast("long").alias("files")), "place").alias("best"))
    return best.select("subject", "best.kind", "best.path", "best.files")


def used_units(asked: DataFrame) -> DataFrame:
    """asked (subject, option, sidecar: units or null) with units, and conflict: the option differs from the sidecar, and wins."""
    option = F.nullif(F.col("option"), F.lit(""))
    return asked.withColumn("units", F.coalesce(option, "sidecar")).withColumn("conflict", F.coalesce(option != F.col("sidecar"), F.lit(False)))


def failed_checks(subjects: DataFrame, tacs: DataFrame, mid_times: DataFrame, frames: DataFrame, regions: DataFrame, found_regions: DataFrame, units: DataFrame) -> DataFrame:
    """(subject, what, fatal, detail): all that stands against a run, as rows, before anything runs; no row: it can go.

    subjects: (subject). tacs, mid_times, frames: (subject, ...), the files of curves, and rows a time and a frame with used
    (null: not). regions, found_regions: (subject, region) asked for and found. units: of used_units(). Fatal are: no curves, no
    mid-times, no image, and a number of used frames other than that of used times. A region that isn't found, and units by two
    names, are told only.
    """
    lacks = lambda given, what: subjects.join(given.select("subject").distinct(), "subject", "left_anti").select("subject", F.lit(what).alias("what"), F.lit(True).alias("fatal"), F.lit(None).cast("string").alias("detail"))
    used = lambda rows, name: rows.groupBy("subject").agg(F.count_if(F.coalesce("used", F.lit(False))).alias(name))
    both = subjects.join(used(frames, "frames"), "subject").join(used(mid_times, "times"), "subject").where("frames <> times")
    uneven = both.select("subject", F.lit("frames and times differ").alias("what"), F.lit(True).alias("fatal"), F.concat_ws(" and ", "frames", "times").alias("detail"))
    gone = missing(regions, found_regions, ["subject", "region"]).select("subject", F.lit("no such region").alias("what"), F.lit(False).alias("fatal"), F.col("region").cast("string").alias("detail"))
    two = units.where("conflict").select("subject", F.lit("units differ").alias("what"), F.lit(False).alias("fatal"), F.concat_ws(" and ", "option", "sidecar").alias("detail"))
    out = lacks(tacs, "no curves").unionByName(lacks(mid_times, "no mid-times")).unionByName(lacks(frames, "no image"))
    return out.unionByName(uneven).unionByName(gone).unionByName(two)


def refuse(failures: DataFrame, most: int = 20) -> None:
    """Raises ValueError if any row of failed_checks is fatal; the message has most of them at most."""
    rows = failures.where("fatal").orderBy("subject", "what", "detail").limit(most).collect()
    if rows:
        raise ValueError("; ".join(f"{r['subject']}: {r['what']}" + (f" ({r['detail']})" if r["detail"] else "") for r in rows))
