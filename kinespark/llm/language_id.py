"""Language identification: a convolutional network over bytes, trained in numpy, applied to windows of fixed length."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.llm import words
from kinespark.llm._common import map_texts

#: Bytes of a window; widths of the filters; filters of each width.
WINDOW, WIDTHS, FILTERS = 128, (2, 3, 4), 16
#: The most labelled documents that training reads, and windows of each. The only bound on what is read; prediction has none.
SAMPLE_DOCS, SAMPLE_WINDOWS = 3000, 4
EPOCHS, BATCH, RATE, DECAY = 5, 256, 0.01, 1e-5
#: Windows that pass through the network at once.
AT_ONCE = 1024
UNDETERMINED = "und"


@dataclass
class ByteNet:
    """taps[k] (256 x filters) is what the byte at offset k adds to each filter; filters narrower than k + 1 have zeros there."""

    langs: list[str]
    taps: np.ndarray
    bias: np.ndarray
    top: np.ndarray
    top_bias: np.ndarray

    def convolve(self, windows: np.ndarray) -> np.ndarray:
        """Filter values at each place of each window (windows x places x filters)."""
        n = windows.shape[1] - len(self.taps) + 1
        out = self.taps[0][windows[:, :n]]
        for k in range(1, len(self.taps)):
            lo = sum(w <= k for w in WIDTHS) * FILTERS
            out[:, :, lo:] += self.taps[k][:, lo:][windows[:, k : k + n]]
        return out

    def logits(self, windows: np.ndarray) -> np.ndarray:
        return np.maximum(self.convolve(windows).max(1) + self.bias, 0) @ self.top + self.top_bias

    def log_scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The mean logits of all windows of each text (texts x languages), AT_ONCE windows at once; zeros for an empty text."""
        start, row = places(bounds)
        total = np.zeros((len(bounds) - 1, len(self.langs)))
        for at in range(0, len(row), AT_ONCE):
            part = slice(at, at + AT_ONCE)
            np.add.at(total, row[part], self.logits(cut(data, start[part], bounds[1:][row[part]])))
        return total / np.maximum(np.bincount(row, minlength=len(total)), 1)[:, None]


def places(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each window of each text starts (the last one may be short), and its text."""
    per = -(-np.diff(bounds) // WINDOW)
    row = np.repeat(np.arange(len(per)), per)
    return bounds[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)) * WINDOW, row


def cut(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The windows of WINDOW bytes from these starts, padded with zeros from the ends of their texts.

    A window also holds the first bytes of the next one, so that no filter misses a place between windows.
    """
    place = start[:, None] + np.arange(WINDOW + max(WIDTHS) - 1)
    inside = place < end[:, None]
    place[~inside] = 0
    return np.where(inside, data[place], 0).astype(np.uint8) if len(data) else np.zeros((0, place.shape[1]), np.uint8)


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], seed: int = 7) -> ByteNet:
    """Cross-entropy by Adam; the gradient of max pooling goes to the place of the maximum alone."""
    rng = np.random.default_rng(seed)
    filters = len(WIDTHS) * FILTERS
    width = np.repeat(WIDTHS, FILTERS)
    live = (np.arange(max(WIDTHS))[:, None, None] < width).astype(np.float32)
    net = ByteNet(langs, (rng.normal(0, 0.3, (max(WIDTHS), 256, filters)) * live).astype(np.float32), np.zeros(filters, np.float32), rng.normal(0, 0.2, (filters, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))
    names = ["taps", "bias", "top", "top_bias"]
    first, second = ({k: np.zeros_like(getattr(net, k)) for k in names} for _ in range(2))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            x, y = windows[order[at : at + BATCH]], labels[order[at : at + BATCH]]
            values = net.convolve(x)
            where = values.argmax(1)
            pooled = np.maximum(np.take_along_axis(values, where[:, None], 1)[:, 0] + net.bias, 0)
            logits = pooled @ net.top + net.top_bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            back = (p @ net.top.T) * (pooled > 0)
            grads = {"taps": np.zeros_like(net.taps), "bias": back.sum(0), "top": pooled.T @ p, "top_bias": p.sum(0)}
            for k in range(max(WIDTHS)):
                np.add.at(grads["taps"][k], (x[np.arange(len(x))[:, None], where + k], np.arange(filters)), back)
            grads["taps"] *= live
            step += 1
            for k in names:
                g = grads[k] + DECAY * getattr(net, k)
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                getattr(net, k).__isub__(RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8))
    return net


def fit(docs: DataFrame, train_on: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> ByteNet | None:
    """A network for the languages of the rows that train_on selects; None if no such row has a language and a text.

    It reads windows at hash-random places of about sample_docs documents, as many of each language, chosen by a hash.
    """
    rows = docs.where(train_on & F.col(lang_col).isNotNull() & (F.octet_length(text_col) > 0)).select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy("lang").collect()}
    if not sizes:
        return None
    draw = F.crc32(F.concat(F.lit("draw-"), F.coalesce("id", F.lit(""))).cast("binary")) / F.lit(float(1 << 32))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, sample_docs / len(sizes) / n)])[F.col("lang")]
    place = [F.substring("text", (F.crc32(F.concat(F.lit(f"place-{i}-"), F.coalesce("id", F.lit(""))).cast("binary")) % F.greatest(F.length("text") - WINDOW + 1, F.lit(1)) + 1).cast("int"), F.lit(WINDOW)) for i in range(SAMPLE_WINDOWS)]
    sample = rows.where(draw < share).select("lang", "id", draw.alias("draw"), F.array(*place).alias("places")).orderBy("draw", "id").limit(2 * sample_docs)
    found = sorted((r["id"] or "", r["lang"], *r["places"]) for r in sample.collect())
    langs = sorted({x[1] for x in found})
    data, bounds = words.flat(pa.array([p for x in found for p in x[2:]], pa.string()))
    start, row = places(bounds)
    windows = cut(data, start, bounds[1:][row])
    keep = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
    return train(windows[keep], np.array([langs.index(x[1]) for x in found], np.int64)[row[keep] // SAMPLE_WINDOWS], langs) if len(row) else None


def predict(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, lang_pred, score (the network's probability for it, from the mean over all windows of the whole text).

    A text that is null or has no letter gives und and score 0, and so does every text if net is None. A very long text is
    read whole, some windows at a time. Ids may repeat or be null; other columns are not read. An empty table gives an
    empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, bounds in words.groups(batch.column(1)):
                n = len(bounds) - 1
                mean = net.log_scores(data, bounds)
                p = np.exp(mean - mean.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array([net.langs[k] for k in best], pa.string()), pa.array(p[np.arange(n), best].astype(np.float64)), batch.column(2).slice(at, n)], ["id", "lang", "p", "letter"])

    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), letter.alias("letter"))
    if net is None:
        return rows.select(F.col("id").alias(id_col), F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    out = rows.transform(map_texts, run, f"id {rows.schema['id'].dataType.simpleString()}, lang string, p double, letter boolean")
    return out.select(F.col("id").alias(id_col), F.when(F.col("letter"), F.col("lang")).otherwise(UNDETERMINED).alias("lang_pred"), F.when(F.col("letter"), F.col("p")).otherwise(0.0).alias("score"))
