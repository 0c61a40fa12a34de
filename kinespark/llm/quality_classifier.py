"""Quality by hierarchical empirical Bayes: a document classifier's evidence, shrunk through posteriors of host and path."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.llm import words
from kinespark.llm._common import attach_groups, map_texts, scratch, stage

#: The most labelled rows that the document classifier is fitted on, chosen by a hash. Nothing else is bounded.
SAMPLE_ROWS = 20_000
#: Ridge penalty and steps of the logistic regression; bounds of a document's and a site's log-odds.
PENALTY, STEPS, MOST_EVIDENCE, MOST_SITE = 1.0, 30, 8.0, 4.0
#: A prior counts as many documents as the spread between sites says, within these bounds.
LEAST_PRIOR, MOST_PRIOR = 2.0, 10_000.0
#: Documents with a posterior under this are rejected.
THRESHOLD = 0.5
FEATURES = ("log_words", "word_length", "upper", "digit", "symbol", "stop", "pause", "other_mark", "non_ascii", "repeat_words", "separator_words", "log_lines")


def _kind(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


_SPACE, _STOP, _PAUSE, _SYMBOL = (_kind(x) for x in (b" \t\n\v\f\r", b".!?", b",;:", b"#*$%&|<>"))
_UPPER, _DIGIT, _LINE = _kind(bytes(range(65, 91))), _kind(b"0123456789"), _kind(b"\n")
_OTHER = _kind(b"\"'()-/=@[\\]^_`{}~+")
_HIGH = (np.arange(256) >= 0xC0).astype(np.int64)


def features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The FEATURES of each text (texts x features); of a text without words all are 0."""

    def total(kind: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kind[data], out=sums[1:])
        return np.diff(sums[bounds]).astype(float)

    starts, ends, first = words.spans(data, bounds)
    n, row = np.diff(first).astype(float), words.rows_of(first)
    chars = np.maximum(np.diff(bounds) - total(_SPACE), 1)
    key = words.mix(words.hashes(data, starts, ends, lower=True) ^ words.mix(row.astype(np.uint64)))
    order = np.argsort(key)
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order][1:] == key[order][:-1]
    marks = np.zeros(len(data) + 1, np.int64)
    np.cumsum((_SYMBOL | _OTHER)[data], out=marks[1:])
    bare = marks[ends] - marks[starts] == ends - starts
    some = np.maximum(n, 1)
    out = np.stack([np.log1p(n), np.log1p(chars / some), *[np.sqrt(total(k) / chars) for k in (_UPPER, _DIGIT, _SYMBOL, _STOP, _PAUSE, _OTHER, _HIGH)],
                    np.bincount(row[again], minlength=len(n)) / some, np.sqrt(np.bincount(row[bare], minlength=len(n)) / some), np.log1p(total(_LINE))], 1)
    return out * (n > 0)[:, None]


@dataclass
class DocumentClassifier:
    """Logistic regression on standardised features; prior is the share of good documents among those it was fitted on."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights + self.bias, -MOST_EVIDENCE, MOST_EVIDENCE)


def fit_features(x: np.ndarray, y: np.ndarray) -> DocumentClassifier:
    """Newton's method with a ridge penalty; with one class alone, or no row, the classifier says the prior for all."""
    n, m = len(x), len(FEATURES)
    prior = float((y.sum() + 1) / (n + 2))
    mean, scale = (x.mean(0), x.std(0)) if n else (np.zeros(m), np.ones(m))
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.c_[(x - mean) / scale, np.ones(n)]
    w = np.r_[np.zeros(m), np.log(prior / (1 - prior))]
    if n and 0 < y.sum() < n:
        ridge = np.diag(np.r_[np.full(m, PENALTY), 1e-6])
        for _ in range(STEPS):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-6)[:, None]) + ridge, z.T @ (y - p) - ridge @ w)
            w += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-8:
                break
    return DocumentClassifier(mean, scale, w[:-1], float(w[-1]), prior)


def with_features(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """The keep columns and feats (array of double) of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, bounds in words.groups(batch.column(0)):
                n = len(bounds) - 1
                flat = features(data, bounds).ravel()
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(FEATURES), pa.int32()), pa.array(flat)), *[batch.column(1 + i).slice(at, n) for i in range(len(keep))]], ["feats", *keep])

    rows = docs.select(F.col(text_col).alias("text"), *keep)
    return rows.transform(map_texts, run, "feats array<double>, " + ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DocumentClassifier:
    """A classifier from documents that have a label (1 good, 0 poor), sample_rows of them at most, chosen by a hash of the id."""
    wanted = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    chosen = stage(wanted.orderBy(F.xxhash64(F.lit("fit"), "id"), "id").limit(sample_rows), "labelled")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    found = sorted((r["id"], r["label"], r["feats"]) for r in with_features(rows, ["id", "label"], "text").collect())
    return fit_features(np.array([x[2] for x in found], float).reshape(-1, len(FEATURES)), np.array([x[1] for x in found], float))


def _strength(mean: Column, between: Column) -> Column:
    """Documents that a Beta prior with this mean counts for, given the variance of the true rates between its groups."""
    return F.least(F.greatest(mean * (1 - mean) / F.greatest(between, F.lit(1e-9)) - 1, F.lit(LEAST_PRIOR)), F.lit(MOST_PRIOR))


def site_sums(paths: DataFrame) -> DataFrame:
    """paths (host, path, n, p_sum, good_sum) with host_n, host_good, all_n, all_good, host_prior, path_prior.

    The spread of hosts around the global rate gives the strength of a host's prior; the spread of paths around their
    hosts, pooled, that of a path's. Spreads are by moments of the classifier's probabilities, less what chance alone gives;
    labels don't enter them.
    """
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("p_sum").alias("host_p"), F.sum("good_sum").alias("host_good"))
    # Totals are one row; joined to groups, of which there are far fewer than documents.
    total = hosts.agg(F.coalesce(F.sum("host_n"), F.lit(0)).alias("all_n"), F.coalesce(F.sum("host_p"), F.lit(0.0)).alias("all_p"), F.coalesce(F.sum("host_good"), F.lit(0.0)).alias("all_good"))
    placed = hosts.crossJoin(F.broadcast(total)).withColumn("rate", F.col("all_p") / F.col("all_n"))
    chance = lambda rate: rate * (1 - rate)
    spread = placed.agg(F.sum(F.col("host_n") * (F.col("host_p") / F.col("host_n") - F.col("rate")) ** 2 - chance(F.col("rate"))).alias("x"), F.sum("host_n").alias("y"))
    shrunk = placed.crossJoin(F.broadcast(spread)).withColumn("host_prior", _strength(F.col("rate"), F.col("x") / F.col("y"))).drop("x", "y")
    shrunk = shrunk.withColumn("host_rate", (F.col("host_prior") * F.col("rate") + F.col("host_p")) / (F.col("host_prior") + F.col("host_n")))
    inner = paths.join(shrunk, "host")
    within = inner.agg(F.sum(F.col("n") * (F.col("p_sum") / F.col("n") - F.col("host_rate")) ** 2 - chance(F.col("host_rate"))).alias("x"), F.sum("n").alias("y"))
    inner = inner.crossJoin(F.broadcast(within)).withColumn("path_prior", _strength(F.col("rate"), F.col("x") / F.col("y")))
    return inner.select("host", "path", "n", "good_sum", "host_n", "host_good", "all_n", "all_good", "host_prior", "path_prior")


def classify(docs: DataFrame, classifier: DocumentClassifier, labels: DataFrame | None = None, host: Column | None = None, path: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of docs: the id, evidence (the classifier's probability), host_rate, site_rate, posterior, kept.

    host and path (default: source, and source with lang) are the levels of a site; null is a site of its own. A site's
    evidence is the sum of its documents' probabilities, or labels where there are any. A document's posterior adds to
    its log-odds how much better or worse than the global rate its site is, all three levels without the document itself:
    given the classifier, its own label never changes its row. Of a table's only document the global rate is one half.
    Documents with a label are judged by the classifier all the same. A text without words has evidence by the features of
    an empty text. Rows with equal or null ids are judged each by itself; of labels that repeat an id the least counts.
    Other columns are not read. Very long texts are read whole. An empty table gives an empty result.
    """
    host = F.col("source") if host is None else host
    path = F.concat_ws("/", F.coalesce(F.col("source"), F.lit("")), F.coalesce(F.col("lang"), F.lit(""))) if path is None else path
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), host.cast("string").alias("host"), path.cast("string").alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, bounds in words.groups(batch.column(0)):
                n = len(bounds) - 1
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(at, n) for i in (1, 2, 3)], pa.array(classifier.log_odds(features(data, bounds)))], ["id", "host", "path", "odds"])

    kind = rows.schema["id"].dataType.simpleString()
    judged = rows.select("text", "id", "host", "path").transform(map_texts, run, f"id {kind}, host string, path string, odds double")
    judged = judged.withColumn("p", 1 / (1 + F.exp(-F.col("odds"))))
    if labels is not None:
        known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("double").alias("label"))
        judged = judged.join(known, "id", "left").withColumn("good", F.coalesce("label", "p")).drop("label")
    else:
        judged = judged.withColumn("good", F.col("p"))
    # A null host or path is told apart from an empty one by a leading mark.
    marked = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    with scratch(docs.sparkSession):
        judged = stage(judged.select("id", marked("host").alias("host"), marked("path").alias("path"), "odds", "p", "good"), "judged", keep=True)
        paths = stage(judged.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("p_sum"), F.sum("good").alias("good_sum")), "sites")
        sites = stage(site_sums(paths), "site-sums", keep=True)
    joined = attach_groups(judged, sites, ["host", "path"], "n")
    shrunk = lambda prior, rate, good, n: (F.col(prior) * F.col(rate) + F.col(good) - F.col("good")) / (F.col(prior) + F.col(n) - 1)
    rate = F.when(F.col("all_n") > 1, (F.col("all_good") - F.col("good")) / (F.col("all_n") - 1)).otherwise(0.5)
    joined = joined.withColumn("rate", rate).withColumn("host_rate", shrunk("host_prior", "rate", "host_good", "host_n")).withColumn("site_rate", shrunk("path_prior", "host_rate", "good_sum", "n"))
    logit = lambda c: F.log(F.greatest(c, F.lit(1e-6)) / F.greatest(1 - c, F.lit(1e-6)))
    shift = F.greatest(F.least(logit(F.col("site_rate")) - logit(F.col("rate")), F.lit(MOST_SITE)), F.lit(-MOST_SITE))
    out = joined.withColumn("posterior", 1 / (1 + F.exp(-(F.col("odds") + shift))))
    return out.select(F.col("id").alias(id_col), F.col("p").alias("evidence"), "host_rate", "site_rate", "posterior", (F.col("posterior") >= THRESHOLD).alias("kept"))
