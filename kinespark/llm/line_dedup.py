"""Line dedup against levelled sorted runs of line hashes. DataFrame operations only."""

from __future__ import annotations

import json
import uuid
from hashlib import sha256

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespark.llm._common import attach_groups, attach_lists, lower_ascii, unused
from kinespark.staging import delete, scratch, stage, stage_dir

#: The white space that is stripped at both ends of a line.
SPACE = " \t\n\v\f\r"
#: Batches of a level whose runs are merged into one of the next level.
FANOUT = 4
#: Keys meant for one bucket of a run, and the most buckets that Spark takes by default.
BUCKET_ROWS, MOST_BUCKETS = 8_000_000, 100_000


def hashed_lines(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(id, h1, h2, places) of each document's distinct keys of min_chars code points at least: lines stripped, A-Z lower-cased."""
    lines = F.split(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), "\n", -1)
    found = docs.select(F.col(id_col).alias("id"), F.posexplode(lines).alias("place", "line"))
    keyed = found.select("id", "place", F.btrim("line", F.lit(SPACE)).alias("key")).where(F.length("key") >= min_chars)
    hashed = keyed.select("id", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))
    # A document's lines stand in one task, so a line that it repeats is one row before the shuffle.
    return hashed.groupBy("id", "h1", "h2").agg(F.collect_list("place").alias("places"))


class LineRuns:
    """Levelled runs of keys (h1, h2, n_docs, keep_id), in a table bucketed and sorted by key, a partition for each run.

    A key stands as two 64-bit hashes, 128 bits together. All runs have the same buckets, so the files of one bucket hold
    the same keys' range of hashes in every run, each sorted: joins and sums over the runs go bucket by bucket and move
    none of their rows. A batch is dealt by the buckets and merge-anti-joins the runs: keys that no run has become its part
    of new keys, so that all these parts together have each key once; the others become its part of repeats, which raise
    the counts of keys known before. Once a level has FANOUT runs, they are merged, bucket by bucket, into one of the next
    level, so the number of runs grows with the logarithm of the batches.

    The list of live runs is a small table of names, written anew after each change; a job that fails in between leaves
    the former list valid, and what it has written is never listed. The files outlive the session: open the runs again
    with the same path. The number of buckets and the type of ids are fixed when they are made.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT, buckets: int | None = None, id_type: str | None = None) -> None:
        self.spark, self.fanout = spark, fanout
        self.path = path or f"{stage_dir(spark)}/line-runs-{uuid.uuid4().hex}"
        self.name = "line_runs_" + sha256(self.path.encode()).hexdigest()[:40]
        made = self._lines_of("made")
        if not made:
            made = [json.dumps({"buckets": buckets or bucket_count(spark, 0), "id_type": id_type or "bigint"})]
            spark.range(1).select(F.lit(made[0]).alias("value")).coalesce(1).write.mode("ignore").text(f"{self.path}/made")
        made = json.loads(made[0])
        for what, asked in (("buckets", buckets), ("id_type", id_type)):
            if asked is not None and asked != made[what]:
                raise ValueError(f"the runs at {self.path} were made with {what} {made[what]}, not {asked}")
        self.buckets = made["buckets"]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (h1 BIGINT, h2 BIGINT, n_docs BIGINT, keep_id {made['id_type']}, run STRING, kind STRING) USING parquet "
            f"PARTITIONED BY (run, kind) CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self.path}/rows'"
        )
        lists = self._lines_of("lists")
        self.live: list[tuple[int, str, str]] = [tuple(x) for x in json.loads(max(lists))[1]] if lists else []
        if self.live:
            spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")

    def _lines_of(self, name: str) -> list[str]:
        """The lines of a small table of names; none if it isn't there yet."""
        try:
            return [r["value"] for r in self.spark.read.text(f"{self.path}/{name}").collect()]
        except AnalysisException as none_yet:
            if "PATH_NOT_FOUND" not in str(none_yet):
                raise
            return []

    def _list(self, live: list[tuple[int, str, str]]) -> None:
        version = max([_number(x[1]) for x in live], default=0)
        line = json.dumps([f"{version:012d}-{uuid.uuid4().hex}", live])
        self.spark.range(1).select(F.lit(line).alias("value")).coalesce(1).write.mode("append").text(f"{self.path}/lists")
        gone = {x[1] for x in self.live} - {x[1] for x in live}
        self.live = live
        for name in gone:
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (run = '{name}')")
            delete(self.spark, f"{self.path}/rows/run={name}")

    def _write(self, rows: DataFrame, level: int, batch: str) -> tuple[int, str, str]:
        """Writes rows (h1, h2, n_docs, keep_id, kind), which stand by buckets, as one run."""
        name = f"level{level}-{1 + max([_number(x[1]) for x in self.live], default=0)}-{uuid.uuid4().hex[:8]}"
        rows.select("h1", "h2", "n_docs", "keep_id", F.lit(name).alias("run"), "kind").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        return level, name, batch

    def rows(self, kind: str | None = None, names: list[str] | None = None) -> DataFrame:
        """The rows of live runs: of kind new, where each key stands once over all runs, of repeats, or of both."""
        names = [name for _, name, _ in self.live] if names is None else names
        found = self.spark.table(self.name).where(F.col("run").isin(names))
        return found if kind is None else found.where(F.col("kind") == kind)

    def merged(self) -> DataFrame:
        """Each key once, with its count and largest id over all live runs."""
        return _summed(self.rows(), [])

    def add(self, lines: DataFrame, batch: str) -> None:
        """Adds a batch of lines (id, h1, h2; a key once a document) under a name, unless a batch of that name is in already; merges levels that are full."""
        if any(batch in b.split("+") for _, _, b in self.live):
            return
        counted = lines.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("id").alias("keep_id"))
        run = self.unseen(counted).withColumn("kind", F.lit("new"))
        if self.live:
            run = run.unionByName(counted.join(self._known(), ["h1", "h2"], "left_semi").withColumn("kind", F.lit("repeats")))
        self._list([*self.live, self._write(run, 0, batch)])
        level = 0
        while len(full := [x for x in self.live if x[0] == level]) >= self.fanout:
            run = self._write(_summed(self.rows(names=[name for _, name, _ in full]), ["kind"]), level + 1, "+".join(b for _, _, b in full))
            self._list([*[x for x in self.live if x[0] != level], run])
            level += 1

    def _known(self) -> DataFrame:
        return self.rows("new").select("h1", "h2").hint("merge")

    def unseen(self, lines: DataFrame) -> DataFrame:
        """Of a batch's rows (h1, h2, ...) those whose key no run has: a merge anti-join, without a shuffle of the runs."""
        return lines.join(self._known(), ["h1", "h2"], "left_anti") if self.live else lines

    def drop(self) -> None:
        """Deletes the runs, files and all."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)


def _number(run: str) -> int:
    return int(run.split("-")[1])


def _summed(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy("h1", "h2", *by).agg(F.sum("n_docs").alias("n_docs"), F.max("keep_id").alias("keep_id"))


def bucket_count(spark: SparkSession, n_rows: int) -> int:
    """Buckets for runs of so many keys: BUCKET_ROWS each, the session's shuffle partitions at least, Spark's limit at most."""
    return min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // BUCKET_ROWS)))


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, runs: LineRuns | None = None, batches: int = 4, id_col: str = "doc_id", text_col: str = "text", name: str = "documents") -> DataFrame:
    """The rows of docs with kept_text, n_lines (before dropping) and n_dropped added (replacing columns of these names).

    A key (a line stripped of ASCII white space, A-Z lower-cased) of min_chars code points that at least min_docs documents
    hold loses all its lines, except in the largest id that holds it. docs come as batches (by a hash of the id); each
    merge-anti-joins the runs and adds its own. What earlier calls have added to lasting runs counts as well; there a call
    is known by its name, and one made again with the same name, docs and batches, after a failure say, counts once.
    A null or empty text has one empty line. Ids must be unique (lines of rows that share an id count as one document's);
    rows with a null id keep all lines and count as no document. Very long texts and documents of very many lines are
    handled in time linear in their lines. Other columns pass unread, whatever their names. An empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    with scratch(spark):
        lines = stage(hashed_lines(docs.where(F.col(id_col).isNotNull()), min_chars, id_col, text_col).withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")), "lines")
        own = runs is None
        runs = runs or LineRuns(spark, buckets=bucket_count(spark, lines.count()), id_type=lines.schema["id"].dataType.simpleString())
        for i in range(batches):
            runs.add(lines.where(F.col("batch") == i).select("id", "h1", "h2"), f"{name}.{i}")
        frequent = stage(runs.merged().where(F.col("n_docs") >= min_docs), "frequent-lines")
        if own:
            runs.drop()
        lost = attach_groups(lines.select("id", "h1", "h2", "places"), frequent, ["h1", "h2"], "n_docs").where(F.col("id") != F.col("keep_id"))
        # A document's lost places are a part of its lines, so the arrays are no larger than the texts.
        by_doc = stage(lost.groupBy("id").agg(F.flatten(F.collect_list("places")).alias("lost")), "lost-lines", keep=True)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rest = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")]
    lost_col, all_col, places_col = (unused(c, docs.columns) for c in ("__lost", "__all", "__places"))
    joined = attach_lists(docs.select(*rest), by_doc.select(F.col("id").alias(id_col), F.col("lost").alias(lost_col)), id_col, lost_col, 4, "left")
    split = joined.select(*rest, lost_col, F.split(text, "\n", -1).alias(all_col))
    # array_except hashes the places, so this is linear; places beyond a text's lines come from rows that share its id.
    places = F.array_except(F.sequence(F.lit(0), F.size(all_col) - 1), lost_col)
    kept = split.withColumn(places_col, F.when(F.col(lost_col).isNotNull(), places))
    line = F.transform(places_col, lambda i: F.get(all_col, i))
    return kept.select(
        *rest,
        F.when(F.col(places_col).isNull(), text).otherwise(F.array_join(line, "\n")).alias("kept_text"),
        F.size(all_col).cast("long").alias("n_lines"),
        F.when(F.col(places_col).isNull(), F.lit(0)).otherwise(F.size(all_col) - F.size(places_col)).cast("long").alias("n_dropped"),
    )
