"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.llm._common import BROADCAST_BYTES, stage

#: Rows of a block, at least, and blocks in all, about, at most: prefix sums run within blocks and over their totals.
BLOCK_ROWS, BLOCKS = 128, 20_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of the text; 0 if it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """Each source's target (source, n_rows, source_size -> and target): sources by code point, null last, take the weights in turn.

    Together they get share times all sizes; none gets over most times its size, and the excess goes to the others by
    weight, again and again. That limit is a water level: with sources by rising cap a weight, all before the first
    that the level doesn't fill stay at their caps, and the others get level times weight.
    """
    # One row a source: a table of names, small beside the documents.
    order, fill = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = sizes.withColumn("place", F.row_number().over(order) - 1).withColumn("weight", weight)
    capped = placed.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    everywhere = Window.partitionBy()
    level = (F.lit(float(share)) * F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(fill), F.lit(0.0))) / (F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(fill), F.lit(0)))
    levelled = capped.withColumn("level", level)
    chosen = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(everywhere)["level"]
    return levelled.withColumn("chosen", chosen).select("source", "n_rows", "source_size", F.least("cap", F.coalesce(F.col("chosen") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights: list[int], share: float = 1.5, most: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: the id, source, size (words), source_size, target (of the source), taken (words the mix takes).

    Within a source rows stand in an order random by a hash of seed and id (ties: id, size). The mix takes them in this
    order, again from the start where the target is over the source's size, and cuts exactly at the target, rounded down:
    in the last round the row at the cut is taken in part. A null text has size 0; a null source is a source of its own;
    rows with equal or null ids are taken one after the other, which of them first doesn't show in the result. Texts of
    any length are read once, to count their words. Other columns are not read. An empty table gives an empty result, which
    reads four small tables in the shared folder.
    """
    key = F.md5(F.concat(F.lit(seed + "-"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    rows = stage(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key")), "mix-rows")
    sizes = stage(rows.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size")), "mix-sources")
    total = sizes.agg(F.sum("n_rows")).first()[0] or 0
    goals = stage(targets(sizes, weights, share, most), "mix-targets")
    # A block is a range of the random key, of about the same number of rows whatever the source.
    blocks = F.ceil(F.col("n_rows") / F.lit(max(BLOCK_ROWS, -(-total // BLOCKS))))
    at = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) * blocks)
    # Both are small, the blocks by their definition; beyond the checked size they are joined by shuffle.
    small = lambda df, n: F.broadcast(df) if n * 100 <= BROADCAST_BYTES else df
    n_sources = goals.count()
    same = F.col("r.source").eqNullSafe(F.col("g.source"))
    placed = rows.alias("r").join(small(goals.alias("g"), n_sources), same).select("r.*", "n_rows", "source_size", "target", at.cast("long").alias("block"))
    sums = placed.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(sums.select("source", "block", F.coalesce(F.sum("block_size").over(before), F.lit(0)).alias("start")), "mix-blocks")
    started = placed.alias("p").join(small(starts.alias("s"), BLOCKS + n_sources), F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p.block") == F.col("s.block"))).select("p.*", "start")
    inside = Window.partitionBy("source", "block").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    parts = max(1, min(-(-total // 100_000), 20_000))
    ranged = started.repartitionByRange(max(parts, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "source", "block")
    first = F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    goal = F.floor("target")
    rounds = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0)
    rest = goal - F.col("rounds") * F.col("source_size")
    taken = F.col("rounds") * F.col("size") + F.greatest(F.lit(0), F.least("size", rest - F.col("first")))
    return ranged.withColumn("first", first).withColumn("rounds", rounds).select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.cast("long").alias("taken"), F.col("first").alias("words_before"))
