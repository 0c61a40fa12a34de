"""Shared pieces: Arrow functions over texts, joins that stand hot keys, and joins chosen by a measured size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespark.staging import scratch, shared_dir, stage  # noqa: F401

#: The most rows that may be broadcast as hot keys: a key is hot if it has at least 1 / HOT_KEYS of the rows.
HOT_KEYS = 2000
#: The most bytes that a join of checked size broadcasts.
BROADCAST_BYTES = 16 << 20
#: Bytes of an Arrow batch of whole texts; a batch is held by the executor's JVM and its Python worker at once.
BATCH_BYTES, _BATCH_SETTING = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_texts(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """rows.mapInArrow(run, schema) in batches of BATCH_BYTES, as 10,000 texts can be too many to hold.

    All Arrow functions of this subpackage go through here, so their batches are the same whatever ran before. The limit is
    the session's setting and is read when the job runs, so it stays as it is made here. A worker that waits for its next
    task keeps no memory that it has freed, as it shares the executor's with the JVM.
    """

    def freeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    conf = rows.sparkSession.conf
    if (now := conf.get(_BATCH_SETTING, None)) is None or not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return rows.mapInArrow(freeing, schema)


def unused(name: str, columns: list[str]) -> str:
    """name, made longer until no column has it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def joins_small(table: DataFrame, row_bytes: int) -> DataFrame:
    """table, which should be staged, marked for broadcast if its rows of row_bytes each are counted to fit BROADCAST_BYTES."""
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table


def attach_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, how: str = "inner") -> DataFrame:
    """rows joined with groups (one row a key; column size has the key's number of rows), whatever the keys' skew.

    Keys with at least 1 / HOT_KEYS of all rows, of which there are HOT_KEYS at most, are broadcast, so that their rows
    stay where they are. The others are joined by shuffle, each in one task: 1 / HOT_KEYS of the rows at most, unless Spark's
    adaptive joins split it further. groups should be staged.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    least = max(2, -(-total // HOT_KEYS))
    hot = groups.where(F.col(size) >= least)
    extra = [c for c in groups.columns if c not in on]
    mark = "__hot"
    marked = rows.join(F.broadcast(hot.withColumn(mark, F.lit(True))), on, "left")
    warm = marked.where(F.col(mark)).select(*rows.columns, *extra)
    cold = marked.where(F.col(mark).isNull()).select(*rows.columns).join(groups.where(F.col(size) < least), on, how)
    return warm.unionByName(cold.select(*rows.columns, *extra))


def attach_lists(left: DataFrame, lists: DataFrame, on: str, column: str, entry_bytes: int, how: str = "inner") -> DataFrame:
    """left joined with lists (one row a key; column is an array of entries of entry_bytes each), which must be staged.

    lists is broadcast if its size, which is counted first, is within BROADCAST_BYTES; else the join is by shuffle.
    """
    size = lists.agg(F.coalesce(F.sum(F.size(column)), F.lit(0)) * entry_bytes + F.count("*") * 48).first()[0]
    return left.join(F.broadcast(lists) if size <= BROADCAST_BYTES else lists, on, how)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (u, v): root is the smallest node that links reach.

    Labels go over the links both ways, the smallest wins, then each label is replaced by its own label, until none
    changes. Nodes with many links are pre-aggregated; each round is written to the shared folder and the one before
    deleted.
    """
    spark = edges.sparkSession
    with scratch(spark):
        both = stage(edges.select("u", "v").union(edges.select("v", "u")).distinct().where("u <> v"), "links")
        labels = stage(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("root")), "labels")
        return stage(_settled(spark, both, labels), "roots", keep=True)


def _settled(spark: SparkSession, both: DataFrame, labels: DataFrame) -> DataFrame:
    """labels once a round changes none; a round's tables but its labels go at its end."""
    changed = True
    while changed:
        with scratch(spark):
            seen = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("root").alias("low"))
            lower = labels.join(seen, labels["node"] == seen["u"], "left").select("node", "root", F.least("root", F.coalesce("low", "root")).alias("new"))
            lower = stage(lower, "lower")
            above = lower.select(F.col("node").alias("at"), F.col("new").alias("above"))
            new = F.least("new", F.coalesce("above", "new"))
            labels = stage(lower.join(above, lower["new"] == above["at"], "left").select("node", new.alias("root"), (F.col("root") != new).alias("changed")), "jumped", keep=True)
        changed = bool(labels.where("changed").limit(1).count())
        labels = labels.select("node", "root")
    return labels
