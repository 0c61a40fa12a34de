"""One text of 10 MB among short ones, through every operator that reads texts (2 MB, of words, for the sampled pieces)."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinespark.llm import exact_dedup, jaccard_join, language_id, license_scan, line_dedup, mixing, periodic_runs, queries, quality_classifier, quality_rules, sentence_pieces, substring_dedup, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTES = 10_000_000


def text_of(size):
    rng = np.random.default_rng(5)
    lines, n = [], 0
    while n < size:
        lines.append(" ".join(f"w{i}" for i in rng.integers(0, 40_000, 12)) + ".")
        n += len(lines[-1]) + 1
    return "\n".join(lines)


@pytest.fixture(scope="module")
def long(spark):
    text = text_of(BYTES)
    rows = [(1, text, "en", "s1"), (2, text.upper(), "en", "s2"), (3, "a short text of some words", "en", "s1"), (4, text[: len(text) // 2], "en", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").cache()
    yield df, {r[0]: r[1] for r in rows}
    df.unpersist()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_counts_and_digests(long):
    df, texts = long
    n = {i: len(WORD.findall(t)) for i, t in texts.items()}
    assert {i: r["size"] for i, r in by_id(mixing.mix(df, [3, 1, 2])).items()} == n
    exact = by_id(exact_dedup.dedup_exact(df))
    assert exact[1]["keep_id"] == exact[2]["keep_id"] == 2 and exact[1]["text_sha256"] == hashlib.sha256(texts[1].encode()).hexdigest()
    rules = by_id(quality_rules.apply_rules(df))
    assert {i: (r["n_words"], r["word_chars"]) for i, r in rules.items()} == {i: (n[i], sum(map(len, WORD.findall(t)))) for i, t in texts.items()}
    tokens = by_id(token_counts.with_token_counts(df, queries.tokenizer_path(queries.TOKENIZER), 2048))
    assert all(tokens[i]["n_bytes"] == len(t) and tokens[i]["n_tokens"] >= n[i] for i, t in texts.items())


def test_groups_lines_and_spans(long):
    df, texts = long
    near = by_id(jaccard_join.near_duplicates(df, 4, 85))
    assert {i: r["component_id"] for i, r in near.items()} == {1: 1, 2: 1, 3: 3, 4: 4}
    w = WORD.findall(texts[1])
    assert near[1]["n_shingles"] == len({tuple(w[i : i + 4]) for i in range(len(w) - 3)})
    lines = by_id(line_dedup.dedup_lines(df))
    held = set(texts[4].split("\n")) & set(texts[1].split("\n"))
    assert lines[1]["n_dropped"] == sum(x in held and len(x) >= 20 for x in texts[1].split("\n")) and lines[4]["n_dropped"] == 0
    spans = by_id(substring_dedup.remove_repeats(df, 20))
    m = len(WORD.findall(texts[4]))
    assert spans[1]["n_removed"] == spans[3]["n_removed"] == 0 and m - 25 <= spans[4]["n_removed"] <= m


def test_runs_licences_languages_and_quality(spark, long):
    df, texts = long
    runs = by_id(periodic_runs.collapse_runs(df.withColumn("text", F.when(F.col("doc_id") == 3, F.repeat(F.lit("x y z "), 1_000_000)).otherwise(F.col("text")))))
    assert runs[3]["collapsed_text"] == "x y z" and tuple(runs[3]["strongest"]) == (0, 3_000_000, 3)
    assert runs[1]["n_words"] == len(WORD.findall(texts[1])) and not runs[1]["runs"]
    scans = by_id(license_scan.scan_licenses(df.withColumn("text", F.concat("text", F.lit(" released under the MIT License")))))
    assert all(r["labels"] == "mit" and r["score"] == 1.0 for r in scans.values())
    net = language_id.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), F.lit(True))
    assert set(by_id(language_id.predict(df, net))) == set(texts)
    assert set(by_id(quality_classifier.classify(df, quality_classifier.fit_features(np.zeros((0, 12)), np.zeros(0))))) == set(texts)


def test_pieces(spark):
    text = text_of(2_000_000)
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    path = queries.tokenizer_path(queries.PIECE_MODEL)
    rows = sentence_pieces.decode(sentence_pieces.encode(df, path, 5, keep=("text",)), path).where(F.col("decoded") == F.col("text"))
    assert rows.count() == 2
