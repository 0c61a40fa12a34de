"""The lasting indexes of exact and line dedup: which path is which index, buckets, merges, and what is left on disk."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kinespark.llm import exact_dedup, line_dedup
from kinespark.staging import shared_dir


def two(spark, first=0):
    return spark.createDataFrame([(first, "one text"), (first + 1, "another text")], "doc_id long, text string")


@pytest.mark.parametrize("a, b", [("idx-a", "idx_a"), ("x/" + "long" * 30, "y/" + "long" * 30)])
def test_each_path_is_an_index_of_its_own(spark, tmp_path, a, b):
    for name in (a, b):
        index = exact_dedup.DigestIndex(spark, str(tmp_path / name), 4)
        assert exact_dedup.dedup_exact(two(spark), index).where("kept").count() == 2
        assert list((tmp_path / name / "rows").glob("*.parquet"))
    again = exact_dedup.DigestIndex(spark, str(tmp_path / a))
    assert again.buckets == 4 and exact_dedup.dedup_exact(two(spark, 10), again).where("kept").count() == 0


def test_an_index_keeps_its_buckets_and_type_of_ids(spark, tmp_path):
    path = str(tmp_path / "index")
    exact_dedup.dedup_exact(two(spark), exact_dedup.DigestIndex(spark, path, 4))
    spark.sql(f"DROP TABLE {exact_dedup.DigestIndex(spark, path).name}")  # as in another session
    with pytest.raises(ValueError, match="buckets 4, not 8"):
        exact_dedup.DigestIndex(spark, path, 8)
    with pytest.raises(ValueError, match="id_type bigint, not string"):
        exact_dedup.DigestIndex(spark, path, id_type="string")
    assert exact_dedup.DigestIndex(spark, path).rows().count() == 2
    line_dedup.LineRuns(spark, path + "-lines", buckets=4)
    with pytest.raises(ValueError, match="buckets 4, not 8"):
        line_dedup.LineRuns(spark, path + "-lines", buckets=8)


def test_buckets_follow_the_rows(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert exact_dedup.bucket_count(spark, 10) == least == line_dedup.bucket_count(spark, 10)
    assert exact_dedup.bucket_count(spark, 10**10) > 1000 and line_dedup.bucket_count(spark, 10**10) == 1250
    assert exact_dedup.bucket_count(spark, 10**15) == line_dedup.bucket_count(spark, 10**15) == 100_000


def test_own_indexes_are_deleted(spark):
    shared = Path(re.sub("^file:", "", shared_dir(spark)))
    before, tables = set(shared.iterdir()), len(spark.catalog.listTables())
    assert exact_dedup.dedup_exact(two(spark)).where("kept").count() == 2
    assert line_dedup.dedup_lines(two(spark)).count() == 2
    assert len(spark.catalog.listTables()) == tables
    left = {re.sub("-[0-9a-f]{32}$", "", p.name) for p in set(shared.iterdir()) - before}
    assert left == {"digests", "digest-groups", "lost-lines"}  # what the results read


def lines(spark, low, high):
    key = F.concat(F.lit("line "), F.col("id").cast("string"))
    return spark.range(low, high).select("id", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("x"), key).alias("h2"))


def test_runs_are_bucketed_sorted_and_merged_by_bucket(spark, tmp_path):
    runs = line_dedup.LineRuns(spark, str(tmp_path / "runs"), fanout=2, buckets=4)
    for i in range(4):
        runs.add(lines(spark, 500 * i, 500 * i + 700), f"batch {i}")
    assert [level for level, _, _ in runs.live] == [2]
    (name,) = [name for _, name, _ in runs.live]
    assert [p.name for p in (tmp_path / "runs" / "rows").iterdir() if p.name.startswith("run=")] == [f"run={name}"]
    files = sorted((tmp_path / "runs" / "rows" / f"run={name}" / "kind=new").glob("*.parquet"))
    assert len(files) == 4
    bucket = F.pmod(F.hash("h1", "h2"), F.lit(4))
    for file in files:
        found = [(r["h1"], r["h2"]) for r in spark.read.parquet(str(file)).select("h1", "h2").collect()]
        assert found == sorted(found)
        assert spark.read.parquet(str(file)).select(bucket).distinct().count() == 1
    merged = {(r["h1"], r["h2"]): (r["n_docs"], r["keep_id"]) for r in runs.merged().collect()}
    want = {(r["h1"], r["h2"]): (2 if 500 <= r["id"] < 700 or 1000 <= r["id"] < 1200 or 1500 <= r["id"] < 1700 else 1, r["id"]) for r in lines(spark, 0, 2200).collect()}
    assert merged == want


def test_a_batch_moves_no_row_of_the_runs(spark, tmp_path):
    runs = line_dedup.LineRuns(spark, str(tmp_path / "runs"), buckets=4)
    runs.add(lines(spark, 0, 500), "first")
    runs.add(lines(spark, 400, 900), "second")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    joined = plan(runs.unseen(lines(spark, 0, 2000)))
    known = joined[joined.rindex("+- Sort") :]  # the right side of the merge join
    assert "SortMergeJoin" in joined and "LeftAnti" in joined and "Bucketed: true" in known and "Exchange" not in known
    assert joined.count("Exchange hashpartitioning") == 1
    assert "Exchange" not in plan(runs.merged())
    again = line_dedup.LineRuns(spark, str(tmp_path / "runs"))
    spark.sql(f"DROP TABLE {again.name}")  # as in another session
    again = line_dedup.LineRuns(spark, str(tmp_path / "runs"))
    assert again.merged().count() == 900 and again.rows("new").count() == 900 and again.rows("repeats").count() == 100


def test_columns_named_like_those_inside(spark, sf):
    import corpus_pipeline

    rows = [(i, "a line that is long enough to count\nown line %d" % i, "en", "s", 10) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("__lost", "__ALL", "__places", "__id", "__times", "__time", "__hot", "places", "n_docs", "keep_id", "batch"):
        docs = docs.withColumn(name, F.lit("clash"))
    found = {r["doc_id"]: (r["kept_text"], r["__lost"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert found == {i: (f"own line {i}", "clash") for i in range(3)} | {3: (rows[3][1], "clash")}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and {r["__id"] for r in out.collect()} <= {"clash"}
