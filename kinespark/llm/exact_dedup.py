"""Exact dedup against a persistent digest index, a table bucketed and sorted by digest. DataFrame operations only."""

from __future__ import annotations

import json
import uuid
from hashlib import sha256

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespark.llm._common import attach_groups, lower_ascii, shared_dir, stage
from kinespark.staging import delete

#: Bytes meant for one bucket, of a row of the index, about, and the most buckets that Spark takes by default.
BUCKET_BYTES, ROW_BYTES, MOST_BUCKETS = 256 << 20, 100, 100_000


def digest(text: Column) -> Column:
    """SHA-256 in lowercase hex of the text with A-Z lower-cased; a null text counts as empty."""
    return F.sha2(F.encode(lower_ascii(F.coalesce(text, F.lit(""))), "UTF-8"), 256)


class DigestIndex:
    """A table (digest, keep_id, batch) with each known digest once, in files bucketed and sorted by digest.

    The files outlive the session: open the index again with the same path. The number of buckets and the type of ids are
    fixed when an index is made and kept beside its rows; opening it with others is an error, opening it without any takes
    those. Each path is an index of its own. A batch is appended by one Spark write, which commits whole or not at all; a
    batch whose number is already in the index is not added twice, so a failed job can simply be run again.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, id_type: str | None = None) -> None:
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex}"
        self.name = "digest_index_" + sha256(self.path.encode()).hexdigest()[:40]
        made = self._made()
        if made is None:
            made = {"buckets": buckets or bucket_count(spark, 0), "id_type": id_type or "bigint"}
            spark.range(1).select(F.lit(json.dumps(made)).alias("value")).coalesce(1).write.mode("ignore").text(f"{self.path}/made")
        for what, asked in (("buckets", buckets), ("id_type", id_type)):
            if asked is not None and asked != made[what]:
                raise ValueError(f"the index at {self.path} was made with {what} {made[what]}, not {asked}")
        self.buckets, self.id_type = made["buckets"], made["id_type"]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest STRING, keep_id {self.id_type}, batch INT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/rows'"
        )

    def _made(self) -> dict | None:
        try:
            return json.loads(self.spark.read.text(f"{self.path}/made").first()[0])
        except AnalysisException as none_yet:
            if "PATH_NOT_FOUND" not in str(none_yet):
                raise
            return None

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, digests: DataFrame, batch: int) -> None:
        """Adds the digests (digest, id) that the index lacks, each with its largest id; a sort-merge anti-join finds them.

        The index side needs no shuffle and no sort beyond its buckets; digests are pre-aggregated before their shuffle.
        """
        if self.rows().where(F.col("batch") == batch).limit(1).count():
            return
        new = digests.groupBy("digest").agg(F.max("id").alias("keep_id"))
        known = self.rows().select("digest")
        novel = new.join(known.hint("merge"), "digest", "left_anti").select("digest", "keep_id", F.lit(batch).alias("batch"))
        novel.write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def drop(self) -> None:
        """Deletes the index, files and all."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)


def bucket_count(spark: SparkSession, n_rows: int) -> int:
    """Buckets for an index of so many rows: BUCKET_BYTES each, the session's shuffle partitions at least, Spark's limit at most."""
    return min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows * ROW_BYTES // BUCKET_BYTES)))


def dedup_exact(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z; null counts as empty. docs arrive as batches in falling order of
    their ids (equal ranges of ids), each deduplicated against the index and appended to it, so of equal texts in docs the
    largest id stays; a text that an earlier run has put into the index stays with that run's row, and all its copies in
    docs go. group_size counts the rows of docs with the text. Ids should be unique; where a kept id repeats with the same
    text, all rows of it are kept. Rows with a null id are never kept while another copy has an id. Other columns are not
    read. Texts of any length are read once, to be digested. An empty table gives an empty result. Without an index one of
    its own is made, as large as docs need, and deleted again; a lasting one should be made for as many rows as it will
    hold (bucket_count()). The result reads two tables of digests in the shared folder.
    """
    spark = docs.sparkSession
    digests = stage(docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest")), "digests")
    low, high, n_rows = digests.agg(F.min("id"), F.max("id"), F.count("*")).first()
    own = index is None
    index = index or DigestIndex(spark, buckets=bucket_count(spark, n_rows), id_type=digests.schema["id"].dataType.simpleString())
    done = (index.rows().agg(F.max("batch")).first()[0] or 0) + 1
    cuts = [low + (high - low) * i // batches for i in range(batches - 1, 0, -1)] if isinstance(low, int) else []
    above = None
    for i, cut in enumerate([*cuts, None]):
        part = F.lit(True) if cut is None else F.col("id") > cut
        part = part if above is None else part & (F.col("id") <= above) if cut is not None else (F.col("id") <= above) | F.col("id").isNull()
        index.add(digests.where(part), done + i)
        above = cut
    sizes = digests.groupBy("digest").agg(F.count("*").alias("group_size"))
    groups = stage(sizes.join(index.rows().select("digest", "keep_id"), "digest"), "digest-groups")
    if own:
        index.drop()
    out = attach_groups(digests, groups, ["digest"], "group_size")
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))
