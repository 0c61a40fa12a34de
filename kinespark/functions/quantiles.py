"""Exact quantiles of any number of rows: rounds of counts in bins of values, so that no task has all values of a key."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinespark.staging import scratch, stage

BINS = 1024
#: So many values of a key at most are sorted in one task.
FEW = 10_000


def quantiles(rows: DataFrame, keys: list[str], value: str, share: float, bins: int = BINS, few: int = FEW) -> DataFrame:
    """(keys, value) of each key: the quantile at share (0 to 1), linear between the two values about it, as exact as percentile().

    The ranks of both are sought in a range of values that a round cuts into bins: rows in it are counted by key and bin, with
    the least and greatest value of each bin, before anything is shuffled; a key's bins, which are so many at most, tell in
    which the ranks are. A key is done when these are two bins, whose ends are then the two values, or when all values of
    their one bin are the same, so ties end a search at once. Each round divides the range by the number of bins at least and
    reads the rows anew. Where few values are left in a key's range, or it has no more from the start, these are sorted.

    Rows with a null or no finite value don't count; a key of no other row has no row. Null keys are a key. Other columns of
    rows are not read.
    """
    if not 0 <= share <= 1:
        raise ValueError("share is from 0 to 1")
    own = [f"k{i}" for i in range(len(keys))]
    finite = F.abs(F.col(value).cast("double")) < F.lit(float("inf"))
    read = rows.where(finite).select(*[F.col(c).alias(k) for c, k in zip(keys, own, strict=True)], F.col(value).cast("double").alias("v"))
    rank = F.lit(float(share)) * (F.col("n") - 1)
    ends = read.groupBy(*own).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    ends = ends.select(*own, F.floor(rank).alias("first"), F.ceil(rank).alias("second"), (rank - F.floor(rank)).alias("part"), F.lit(0).cast("long").alias("below"), "n", "low", "high")
    with scratch(rows.sparkSession):
        ends = stage(ends, "quantile-ends", keep=True)
        left, small, done = ends.where(F.col("n") > few), ends.where(F.col("n") <= few), []
        while not left.isEmpty():
            found = stage(_round(read, left, own, bins), "quantile-round")
            done.append(found.where("low = high OR first_bin <> second_bin"))
            more = found.where("low < high AND first_bin = second_bin").select(*ends.columns)
            left, small = more.where(F.col("n") > few), small.unionByName(more.where(F.col("n") <= few))
        last = ["part", "low", "high"]
        whole = reduce(DataFrame.unionByName, [d.select(*own, *last) for d in done], _sorted(read, small, own).select(*own, *last))
        if done:  # what the rounds have written goes at the end of the block
            whole = stage(whole, "quantiles", keep=True)
    between = F.when((F.col("low") == F.col("high")) | (F.col("part") == 0), F.col("low")).otherwise(F.col("low") * (1 - F.col("part")) + F.col("high") * F.col("part"))
    return whole.select(*[F.col(k).alias(c) for c, k in zip(keys, own, strict=True)], between.alias(value))


def _inside(read: DataFrame, ranges: DataFrame, own: list[str]) -> DataFrame:
    """The rows of read within the range of their key, with the range's columns. A row a key: joined as Spark sees fit."""
    named = ranges.select(*[F.col(k).alias(f"r{k}") for k in own], *[c for c in ranges.columns if c not in own])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"r{k}")) for k in own], F.lit(True))
    return read.join(named, same).where(F.col("v").between(F.col("low"), F.col("high")))


def _sorted(read: DataFrame, ranges: DataFrame, own: list[str]) -> DataFrame:
    """(own, part, low, high): the values at both ranks, of ranges with few values."""
    fixed = ["first", "second", "part", "below"]
    values = _inside(read, ranges, own).groupBy(*own).agg(F.sort_array(F.collect_list("v")).alias("values"), *[F.first(c).alias(c) for c in fixed])
    at = lambda rank: F.get("values", (F.col(rank) - F.col("below")).cast("int"))
    return values.select(*own, "part", at("first").alias("low"), at("second").alias("high"))


def _round(read: DataFrame, ranges: DataFrame, own: list[str], bins: int) -> DataFrame:
    """ranges (own, ranks first and second, part, below, low, high) cut down to the bins of the two ranks, with the bins' numbers.

    below counts a key's rows under low. Of two bins, low is the greatest value of the first rank's and high the least of the second's.
    """
    v, low, high = F.col("v"), F.col("low"), F.col("high")
    # Halves, as the width of a range may be too large for a double.
    at = F.when(low < high, (v / 2 - low / 2) / (high / 2 - low / 2) * bins).otherwise(0.0)
    inside = _inside(read, ranges, own).drop("n").withColumn("bin", F.least(F.floor(at), F.lit(bins - 1)))
    fixed = ["first", "second", "part", "below"]
    counts = inside.groupBy(*own, "bin").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), *[F.first(c).alias(c) for c in fixed])
    through = F.col("below") + F.sum("n").over(Window.partitionBy(*own).orderBy("bin"))  # a row a bin
    placed = counts.withColumn("through", through).withColumn("start", F.col("through") - F.col("n"))
    has = lambda rank: F.when((F.col(rank) >= F.col("start")) & (F.col(rank) < F.col("through")), F.struct("bin", "least", "most", "start", "n"))
    found = placed.groupBy(*own).agg(F.max(has("first")).alias("a"), F.max(has("second")).alias("b"), *[F.first(c).alias(c) for c in fixed[:3]])
    one = F.col("a.bin") == F.col("b.bin")
    return found.select(
        *own, "first", "second", "part", F.col("a.start").alias("below"), F.col("a.n").alias("n"), F.when(one, F.col("a.least")).otherwise(F.col("a.most")).alias("low"),
        F.when(one, F.col("a.most")).otherwise(F.col("b.least")).alias("high"), F.col("a.bin").alias("first_bin"), F.col("b.bin").alias("second_bin"),
    )
