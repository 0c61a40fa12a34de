"""Substring dedup by suffix automata: documents are streamed for matching statistics, and long repeated spans are removed.

The reference is the corpus itself, which no broadcast holds. Its shards are therefore made by content: every window of
words has an anchor (the least hash of its shorter runs of words), equal windows have equal anchors, and a shard holds the
stretches around one anchor. Only anchors found twice or more make shards. A shard's stretches are streamed in the order
of the documents through the automaton of those before them, so a window that it knows has started earlier.

Anchors of more than HOT_STRETCHES stretches would make large shards. All anchors are counted, by an aggregation that combines
within tasks first, and the windows of those are instead compared by key: each window's earliest start is found by such an
aggregation, too. So no shard has more than HOT_STRETCHES stretches, however often and evenly a phrase is spread. Which
anchors are treated so decides the cost alone; both ways find the same windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kinespark.llm import words
from kinespark.llm._common import attach_groups, attach_lists, map_texts, scratch, stage
from kinespark.llm.suffix_automaton import SuffixAutomaton

#: Words of the runs whose least hash anchors a window.
ANCHOR_WORDS = 8
#: The most stretches of a shard; one more, and the anchor is hot.
HOT_STRETCHES = 1000


def anchored(hashed: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The stretches of all texts: (anchor, text, word of the anchor, first and last window start), words counted over all texts.

    A stretch is a run of windows of one text with the same anchor at the same place.
    """
    row = words.rows_of(first)
    count = len(hashed) - window + 1
    if count <= 0:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none, none
    grams = words.shingles(hashed, ANCHOR_WORDS)
    span = window - ANCHOR_WORDS + 1
    place = np.lib.stride_tricks.sliding_window_view(grams, span).argmin(1) + np.arange(count)
    starts = np.flatnonzero(row[:count] == row[window - 1 :])
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none, none
    new = np.ones(len(starts), bool)
    new[1:] = (place[starts][1:] != place[starts][:-1]) | (row[starts][1:] != row[starts][:-1])
    begin = np.flatnonzero(new)
    last = starts[np.append(begin[1:], len(starts)) - 1]
    at = place[starts[begin]]
    return grams[at], row[starts[begin]], at, starts[begin], last


def _scan(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, tuple[np.ndarray, ...]]]:
    for at, data, bounds in words.groups(texts):
        starts, ends, first = words.spans(data, bounds)
        yield at, data, bounds, (starts, ends, first, words.hashes(data, starts, ends, lower=False))


def flagged(stretches: Iterator[tuple[int, int, list[bytes]]], window: int) -> Iterator[tuple[int, int, int]]:
    """Of one shard's stretches (id, first word, words), in rising order: (id, from, to) of words in windows that started earlier.

    An automaton is made only once a stretch differs from those before it.
    """
    seen: dict[tuple[bytes, ...], int] = {}
    automaton, waiting, before = None, [], None
    for ident, start, sequence in stretches:
        key = tuple(sequence)
        if before == (ident, start, key):  # the same row again
            continue
        before = (ident, start, key)
        if key in seen:
            yield ident, start, start + len(sequence)
            continue
        if seen:
            if automaton is None:
                automaton = SuffixAutomaton()
            for earlier in waiting:
                automaton.add(earlier)
            waiting = []
            known = [i - window + 1 for i, size in enumerate(automaton.matches(sequence)) if size >= window]
            for k, i in enumerate(known):
                if not k or known[k - 1] != i - 1:
                    low = i
                if k + 1 == len(known) or known[k + 1] != i + 1:
                    yield ident, start + low, start + i + window
        seen[key] = 1
        waiting.append(sequence)


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, n_words, n_removed, kept_text (kept words joined by one space).

    A word goes if it stands in a window (so many consecutive words of a document) whose words also stand at an earlier
    start: in a document with a smaller id, or earlier in the same one; all windows are judged on the input. So of each
    maximal span of window words or more that repeats, the earliest occurrence stays. A document whose words are those of
    one with a smaller id loses all of them, if it has a window, and takes no part in the search. Words are unchanged
    maximal runs without ASCII white space; null counts as empty. Ids must be unique (rows that repeat id and text count
    as one); rows with a null id keep all words and count for no other. Ids may be of any type that Spark orders. Very long
    texts are read whole. Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    with scratch(spark):
        gone = stage(_gone(rows, window), "gone", keep=True)
    kind = rows.schema["id"].dataType.simpleString()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, stays = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            for at, data, bounds in words.groups(batch.column(1)):
                raw, kept, n_words, n_removed = data.tobytes(), [], [], []
                later = _later(data, bounds, batch.column(3).slice(at, len(bounds) - 1), stays[at : at + len(bounds) - 1], window)
                for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    found = raw[a:b].split()
                    n_words.append(len(found))
                    if lists[at + i] or i in later:
                        lost = np.zeros(len(found), bool)
                        for span in lists[at + i] or ():
                            lost[span["low"] : span["high"]] = True
                        for start in later.get(i, ()):
                            lost[start : start + window] = True
                        found = [w for w, x in zip(found, lost.tolist(), strict=True) if not x]
                    n_removed.append(n_words[-1] - len(found))
                    kept.append(b" ".join(found).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(kept)), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept_text"])

    final = rows.join(gone, "id", "left").select("id", "text", "gone", "hot", "stays")
    return final.transform(map_texts, keep, f"id {kind}, n_words long, n_removed long, kept_text string").withColumnRenamed("id", id_col)


def _later(data: np.ndarray, bounds: np.ndarray, hot: pa.Array, stays: list[list[int] | None], window: int) -> dict[int, list[int]]:
    """By text, the starts of windows with hot anchors that aren't among those that stay."""
    if hot.null_count == len(hot):
        return {}
    starts, ends, first = words.spans(data, bounds)
    lists = pa.array([x or [] for x in hot.to_pylist()], pa.list_(pa.int32()))
    start, row = _hot_windows(words.hashes(data, starts, ends, lower=False), first, lists, window)
    out: dict[int, list[int]] = {}
    for i in np.unique(row).tolist():
        own = start[row == i] - first[i]
        out[i] = own[~np.isin(own, np.array(stays[i] or [], np.int64))].tolist()
    return out


def _single(rows: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """The rows with a window that no smaller id has the same words as; the ids of those that one has."""
    kind = rows.schema["id"].dataType.simpleString()
    real = rows.where(F.col("id").isNotNull() & (F.octet_length("text") >= 2 * window - 1))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, _, (_, _, first, hashed) in _scan(batch.column(1)):
                keys = [blake2b(hashed[a:b].tobytes(), digest_size=16).digest() if b - a >= window else None for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(keys)), pa.array(keys, pa.binary())], ["id", "words_key"])

    known = stage(real.transform(map_texts, keyed, f"id {kind}, words_key binary").where(F.col("words_key").isNotNull()), "word-keys")
    classes = stage(known.groupBy("words_key").agg(F.min("id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1"), "word-classes")
    # array() stands for a list in attach_lists: a copy has no stretches.
    copies = attach_groups(known.select("id", "words_key"), classes, ["words_key"], "copies").where(F.col("id") != F.col("first_id"))
    copies = stage(copies.select("id", F.array().cast("array<int>").alias("none")).distinct(), "word-copies")
    return attach_lists(real, copies, "id", "none", 0, "left_anti"), copies


def _places(single: DataFrame, window: int) -> DataFrame:
    """(id, cold, hot): the words at which the document has anchors that stand twice or more, by whether they are hot; staged."""
    kind = single.schema["id"].dataType.simpleString()

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, _, (_, _, first, hashed) in _scan(batch.column(1)):
                anchor, row, place, _, _ = anchored(hashed, first, window)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), batch.column(0).take(pa.array(at + row)), pa.array((place - first[row]).astype(np.int32))], ["anchor", "id", "place"])

    with scratch(single.sparkSession):
        found = stage(single.select("id", "text").transform(map_texts, anchors, f"anchor long, id {kind}, place int"), "anchors")
        counts = stage(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "anchor-counts")
        twice = attach_groups(found, counts, ["anchor"], "n")
        # A document's places are a part of its words.
        of_kind = lambda which, name: F.sort_array(F.collect_set(F.when(which, F.col("place")))).alias(name)
        return stage(twice.groupBy("id").agg(of_kind(F.col("n") <= HOT_STRETCHES, "cold"), of_kind(F.col("n") > HOT_STRETCHES, "hot")), "places", keep=True)


def _listed(lists: pa.Array, first: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of stretches, whose anchors stand at place, those in the lists of places, a list a text."""
    size = np.diff(lists.offsets.to_numpy())
    return np.flatnonzero(np.isin(place, np.repeat(first[:-1], size) + lists.flatten().to_numpy()))


def _hot_windows(hashed: np.ndarray, first: np.ndarray, lists: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, text) of the windows whose anchors stand at the listed places, words counted over all texts."""
    _, row, place, low, high = anchored(hashed, first, window)
    here = _listed(lists, first, place)
    low, size = low[here], (high - low + 1)[here]
    return np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum())), np.repeat(row[here], size)


def _first_windows(held: DataFrame, window: int) -> DataFrame:
    """(id, stays): the starts in each document of the windows with a hot anchor that start nowhere earlier.

    A window's earliest start is the least of an aggregation by its 128-bit key, so the others need no row of their own.
    """
    kind = held.schema["id"].dataType.simpleString()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, _, (_, _, first, hashed) in _scan(batch.column(1)):
                start, row = _hot_windows(hashed, first, batch.column(2).slice(at, len(first) - 1), window)
                keys = (words.shingles(hashed, window)[start], words.shingles(words.mix(hashed), window)[start]) if len(start) else (np.zeros(0, np.uint64),) * 2
                yield pa.RecordBatch.from_arrays([*[pa.array(k.view(np.int64)) for k in keys], batch.column(0).take(pa.array(at + row)), pa.array((start - first[row]).astype(np.int32))], ["w1", "w2", "id", "start"])

    rows = held.where(F.size("hot") > 0).select("id", "text", "hot").transform(map_texts, windows, f"w1 long, w2 long, id {kind}, start int")
    firsts = rows.groupBy("w1", "w2").agg(F.min(F.struct("id", "start")).alias("first"))
    return firsts.groupBy("first.id").agg(F.collect_set("first.start").alias("stays"))


def _gone(rows: DataFrame, window: int) -> DataFrame:
    """(id, gone, hot, stays): the ranges of words that each document loses, and its hot anchors, of whose windows all but those that stay go."""
    kind, id_arrow = rows.schema["id"].dataType.simpleString(), to_arrow_type(rows.schema["id"].dataType)
    single, copies = _single(rows, window)
    places = _places(single, window)

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, _, (starts, ends, first, hashed) in _scan(batch.column(1)):
                raw = data.tobytes()
                anchor, row, place, low, high = anchored(hashed, first, window)
                at_i = _listed(batch.column(2).slice(at, len(first) - 1), first, place)
                a, b = starts[low[at_i]], ends[high[at_i] + window - 1]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[at_i].view(np.int64)), batch.column(0).take(pa.array(at + row[at_i])), pa.array((low - first[row])[at_i].astype(np.int32)), pa.array([raw[i:j] for i, j in zip(a, b, strict=True)], pa.binary())], ["anchor", "id", "start", "stretch"])

    held = single.select("id", "text").join(places, "id")
    shards = held.where(F.size("cold") > 0).select("id", "text", "cold").transform(map_texts, stretches, f"anchor long, id {kind}, start int, stretch binary")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one_by_one() -> Iterator[tuple[int, int, int, list[bytes]]]:
            for batch in batches:
                for anchor, ident, start, stretch in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    yield anchor, ident, start, stretch.split()

        def out(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
            ids, low, high = zip(*found, strict=True) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(ids, id_arrow), pa.array(low, pa.int32()), pa.array(high, pa.int32())], ["id", "low", "high"])

        ready: list[tuple[int, int, int]] = []
        source = one_by_one()
        row = next(source, None)
        while row is not None:
            shard = row[0]

            def of_shard(shard=shard) -> Iterator[tuple[int, int, list[bytes]]]:
                nonlocal row
                while row is not None and row[0] == shard:
                    yield row[1:]
                    row = next(source, None)

            for x in flagged(of_shard(), window):
                ready.append(x)
                if len(ready) >= 50_000:
                    yield out(ready)
                    ready = []
        yield out(ready)

    spans = shards.repartition("anchor").sortWithinPartitions("anchor", "id", "start").transform(map_texts, match, f"id {kind}, low int, high int")
    gone = spans.groupBy("id").agg(F.collect_set(F.struct("low", "high")).alias("gone"))
    whole = copies.select("id", F.array(F.struct(F.lit(0).alias("low"), F.lit(2**31 - 1).alias("high"))).alias("gone"))
    hot = places.where(F.size("hot") > 0).select("id", "hot")
    if hot.limit(1).count():
        hot = hot.join(_first_windows(held, window), "id", "left")
    else:
        hot = hot.withColumn("stays", F.lit(None).cast("array<int>"))
    return gone.unionByName(whole).join(hot, "id", "full")
