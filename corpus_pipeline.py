"""The corpus pipeline: each stage reads all that the one before kept. Part of the optional corpus operators (kinespark.llm).

Stages decide by doc_id. Rows that share a doc_id, null being an id of its own here, are one document to them: they stay, go
and are taken as often together (each stage's docstring says by which rule), and each keeps its own columns. All stages stand
null and empty texts, null sources and languages, and empty tables. Columns beyond those of documents pass unread. A
stage's private tables are deleted before it returns, but for the small table of its decisions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespark.llm import jaccard_join, line_dedup, mixing, quality_classifier, sentence_pieces
from kinespark.llm._common import joins_small, table, unused
from kinespark.llm.queries import LINE_MIN_CHARS, LINE_MIN_DOCS, MIX_MOST, MIX_SHARE, MIX_WEIGHTS, PIECE_MODEL, PIECE_SEED, tokenizer_path
from kinespark.staging import scratch, stage

#: Near duplicates: shingles of five words, a similarity of 0.8 or more.
SHINGLE_WORDS, SIMILARITY = 5, 80


def _joined(docs: DataFrame, decided: DataFrame, how: str) -> DataFrame:
    """docs joined with decided (staged; its first column the ids, once each, then fixed-size columns), nulls being equal."""
    return docs.join(joins_small(decided, 24), F.col("doc_id").eqNullSafe(F.col(decided.columns[0])), how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; of rows that share a doc_id all stay if any is kept."""
    labels = table(spark, sf_dir, "labels")
    with scratch(spark):
        judged = quality_classifier.classify(docs, quality_classifier.fit(docs, labels), labels)
        kept = stage(judged.where("kept").select(F.col("doc_id").alias(unused("__id", docs.columns))).distinct(), "kept-ids", keep=True)
    return _joined(docs, kept, "left_semi")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many hold, those that lose all their text excepted; n_chars is that of the new text.

    Rows with a null doc_id lose no line. Rows that share a doc_id lose lines by the places of all their lost lines.
    """
    found = line_dedup.dedup_lines(docs, LINE_MIN_DOCS, LINE_MIN_CHARS)
    left = found.where((F.col("n_dropped") == 0) | (F.length(F.btrim("kept_text", F.lit(line_dedup.SPACE))) > 0))
    return left.withColumn("text", F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.col("kept_text"))).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; rows with a null doc_id are in no group and stay."""
    with scratch(spark):
        found = jaccard_join.near_duplicates(docs, SHINGLE_WORDS, SIMILARITY)
        first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        first = stage(first.select(F.col("doc_id").alias(unused("__id", docs.columns))).distinct(), "first-ids", keep=True)
    return _joined(docs, first, "left_semi")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one that the cut divides is taken if half of it or more is within.

    Rows that share a doc_id are each taken as often as the one of them that is taken most. A document without words isn't
    taken.
    """
    ident, times_col, time_col = (unused(c, docs.columns) for c in ("__id", "__times", "__time"))
    with scratch(spark):
        mixed = mixing.mix(docs, MIX_WEIGHTS, MIX_SHARE, MIX_MOST)
        times = F.when(F.col("size") > 0, F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int")).otherwise(0)
        taken = mixed.groupBy(F.col("doc_id").alias(ident)).agg(F.max(times).alias(times_col)).where(F.col(times_col) > 0)
        taken = stage(taken, "times", keep=True)
    return _joined(docs, taken, "inner").withColumn(time_col, F.explode(F.sequence(F.lit(1), times_col))).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's sampled pieces, and whether they decode to its text; rows with a null doc_id are seeded by the seed alone."""
    encoded = sentence_pieces.encode(docs, tokenizer_path(PIECE_MODEL), PIECE_SEED, keep=("lang", "source"), lossless_col="lossless")
    return encoded.select("doc_id", "lang", "source", F.coalesce(F.size("pieces"), F.lit(0)).cast("long").alias("n_pieces"), "pieces", "lossless")


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("mixing", mix), ("sentence pieces", pieces)]

#: SQL can't express the classifier, nor the sampled pieces; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        with scratch(spark):
            docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
