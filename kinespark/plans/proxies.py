"""Imaging tables derived from the given ones: voxels, cluster labels, frame times, regional and plasma curves, rate constants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KS = (6, 10, 14, 18)
OFFSET = 0.05

#: The same tables as common table expressions.
SQL = {
    "vox": "vox AS (SELECT vec_id AS vox_id, label AS region, unnest(range(1, len(embedding) + 1)) AS frame, CAST(unnest(embedding) AS DOUBLE) + 0.05e0 AS activity FROM embeddings)",
    "clu": "clu AS (SELECT k, vec_id AS vox_id, (label * 3 + vec_id) % k + 1 AS label FROM embeddings CROSS JOIN (SELECT unnest([6, 10, 14, 18]) AS k))",
    "xyz": "xyz AS (SELECT vec_id AS vox_id, label, vec_id % 8 AS x, (vec_id // 8) % 8 AS y, vec_id // 64 AS z FROM embeddings)",
    "tac": "tac AS (SELECT dense_rank() OVER (ORDER BY ym) AS frame, region, activity FROM (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS ym, o_orderpriority AS region, sum(o_totalprice) / 1e6 AS activity FROM orders GROUP BY 1, 2))",
    "pls": "pls AS (SELECT user_id AS curve_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 6e7 AS t, value AS activity, event_id FROM events)",
    "boot": "boot AS (SELECT l_orderkey * 8 + l_linenumber AS curve_id, l_returnflag AS region, l_quantity / 50e0 AS k1, l_discount + 0.1e0 AS k2, l_tax + 0.05e0 AS k3 FROM lineitem)",
    "cent": "cent AS (SELECT k, label, frame, avg(activity) AS activity FROM vox JOIN clu USING (vox_id) GROUP BY k, label, frame)",
}


def sql(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vox_id, region, frame from 1, activity)"""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vox_id"), F.col("label").alias("region"), F.posexplode("embedding").alias("at", "value"))
    return rows.select("vox_id", "region", (F.col("at") + 1).cast("long").alias("frame"), (F.col("value").cast("double") + F.lit(OFFSET)).alias("activity"))


def labels(spark: SparkSession, sf_dir: str, ks: tuple[int, ...] = KS) -> DataFrame:
    """(k, vox_id, label from 1): the labels of several clusterings."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    return rows.select("k", F.col("vec_id").alias("vox_id"), ((F.col("label") * 3 + F.col("vec_id")) % F.col("k") + 1).alias("label"))


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vox_id, label, x, y, z)"""
    v = F.col("vec_id")
    return read(spark, sf_dir, "embeddings").select(v.alias("vox_id"), "label", (v % 8).alias("x"), (F.floor(v / 8) % 8).alias("y"), F.floor(v / 64).alias("z"))


def regional_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, region, activity): months as frames. The months are few, so their numbers come from a small table."""
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    sums = read(spark, sf_dir, "orders").groupBy(month.alias("ym"), F.col("o_orderpriority").alias("region")).agg((F.sum("o_totalprice") / F.lit(1e6)).alias("activity"))
    return sums.select(F.dense_rank().over(Window.orderBy("ym")).cast("long").alias("frame"), "region", "activity")


def plasma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(curve_id, t in minutes, activity, event_id)"""
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01', ts)") / F.lit(6e7)
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("curve_id"), t.alias("t"), F.col("value").alias("activity"), "event_id")


def rate_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(curve_id, region, k1, k2, k3)"""
    rows = read(spark, sf_dir, "lineitem")
    return rows.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("curve_id"), F.col("l_returnflag").alias("region"), (F.col("l_quantity") / F.lit(50.0)).alias("k1"), (F.col("l_discount") + F.lit(0.1)).alias("k2"), (F.col("l_tax") + F.lit(0.05)).alias("k3"))
