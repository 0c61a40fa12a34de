"""Periodic runs by maximal pairs: a bottom-up LCP-interval tree with lists of places by left word.

Two places i < j of a text are a maximal pair of length L if the L words at both are the same, the words after them differ
and the words before them differ. A stretch with period q that nothing extends, of n words, is the maximal pair of its start
and its start + q with L = n - q, and a maximal pair with L >= (TIMES - 1) * (j - i) is such a stretch. So the runs are the
maximal pairs whose distance satisfies the length constraints; where two distances give the same stretch, the smaller one is
its smallest period, as it divides the other.

Only places whose first words (as many as the shortest L that counts) stand twice in the text are in a node of the tree that
counts, so the tree is built over the stretches that these cover.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinespark.llm import words
from kinespark.llm._common import map_texts

#: A node with more left words than this is also searched by one list of all its places.
FEW_CLASSES = 4

Run = tuple[int, int, int]  # start, length, period


class Node:
    """The places of an LCP interval: sorted lists by the word on their left, and, once these are many, one list of all."""

    __slots__ = ("classes", "everywhere", "size")

    def __init__(self, place: int, left: int) -> None:
        self.classes, self.size = {left: [place]}, 1
        self.everywhere: list[int] | None = None

    def near(self, place: int, own: int, reach: int, left: list[int]) -> Iterator[int]:
        """The places within reach of place (which starts with the same words as they, 2 * reach or more) whose left word isn't own."""
        if self.everywhere is None:
            for word, at in self.classes.items():
                if word != own:
                    yield from at[bisect_left(at, place - reach) : bisect_right(at, place + reach)]
            return
        # Places that near each other differ by multiples of one period, so all but the first of them have the same left word.
        at = self.everywhere
        low, here, high = bisect_left(at, place - reach), bisect_left(at, place), bisect_right(at, place + reach)
        if low < here and left[at[low]] != own:
            yield at[low]
        if here < high and left[at[here]] != own:
            yield from at[here:high]

    def take(self, other: Node) -> None:
        """Adds the places of a node that isn't larger."""
        for word, places in other.classes.items():
            if (at := self.classes.get(word)) is None:
                self.classes[word] = places
            else:
                _put(at, places)
        self.size += other.size
        if self.everywhere is not None:
            for places in other.classes.values():
                _put(self.everywhere, places)
        elif len(self.classes) > FEW_CLASSES:
            self.everywhere = sorted(p for at in self.classes.values() for p in at)


def _put(into: list[int], places: list[int]) -> None:
    """Adds sorted places to a sorted list that is as long or longer."""
    if into[-1] < places[0]:
        into.extend(places)
    elif len(places) * 8 > len(into):
        into.extend(places)
        into.sort()
    else:
        for p in places:
            insort(into, p)


def suffix_order(ranks: np.ndarray) -> np.ndarray:
    """The suffixes of a sequence of ranks (1 and up) in lexicographic order, by doubling; only ties are sorted again."""
    n = len(ranks)
    at = np.argsort(ranks, kind="stable")
    out, rank, slots, depth = at.copy(), np.zeros(n, np.int64), np.arange(n), 1
    key = ranks[at]
    while True:
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(at)))
        out[slots] = at
        rank[at] = np.repeat(slots[begin], size) + 1
        tied = np.repeat(size > 1, size)
        if not tied.any():
            return out
        at, slots = at[tied], slots[tied]
        after = at + depth
        second = np.where(after < n, rank[np.minimum(after, n - 1)], 0)
        key = rank[at] * (n + 1) + second
        order = np.argsort(key, kind="stable")
        at, key, depth = at[order], key[order], depth * 2


def common_lengths(sequence: list[int], order: list[int]) -> list[int]:
    """For each suffix in order, the words that it has in common with the one before it (0 for the first)."""
    n, size = len(sequence), 0
    before = [-1] * n
    for a, b in zip(order, order[1:]):
        before[b] = a
    found = [0] * n
    for i in range(n):
        if (j := before[i]) < 0:
            size = 0
            continue
        most = n - max(i, j)
        while size < most and sequence[i + size] == sequence[j + size]:
            size += 1
        found[i] = size
        if size:
            size -= 1
    return [found[i] for i in order]


def maximal_pairs(places: list[int], common: list[int], left: list[int], least_match: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(i, distance, L) of the maximal pairs with L >= least_match and L >= (times - 1) * distance.

    places are the suffixes in lexicographic order, common the words that each has in common with the one before it. The
    tree's nodes are made from the leaves up; a node's pairs are those of places from different children.
    """
    stack: list[tuple[int, Node]] = []
    for k, place in enumerate(places):
        size = common[k + 1] if k + 1 < len(places) else 0
        if size < least_match and not stack:
            continue
        child = Node(place, left[place])
        while stack and stack[-1][0] > size:
            depth, node = stack.pop()
            yield from _pairs(node, child, depth, left, times)
            child = _joined(node, child)
        if stack and stack[-1][0] == size:
            depth, node = stack.pop()
            yield from _pairs(node, child, depth, left, times)
            child = _joined(node, child)
        if size >= least_match:
            stack.append((size, child))


def _joined(a: Node, b: Node) -> Node:
    large, small = (a, b) if a.size >= b.size else (b, a)
    large.take(small)
    return large


def _pairs(a: Node, b: Node, depth: int, left: list[int], times: int) -> Iterator[tuple[int, int, int]]:
    large, small = (a, b) if a.size >= b.size else (b, a)
    if len(large.classes) == 1 and small.classes.keys() == large.classes.keys():
        return
    reach = depth // (times - 1)
    for own, places in small.classes.items():
        for j in places:
            for i in large.near(j, own, reach, left):
                yield min(i, j), abs(i - j), depth


def runs_of(hashed: np.ndarray, first: np.ndarray, least: int, times: int) -> list[list[Run]]:
    """The runs of each text, by start and period; first is each text's first word (one entry more than texts)."""
    out: list[list[Run]] = [[] for _ in range(len(first) - 1)]
    least_match = least - least // times
    row = words.rows_of(first)
    count = len(hashed) - least_match + 1
    if count < 2:
        return out
    # Words of different texts never match, as each carries its text's number.
    own = words.mix(hashed ^ words.mix(row.astype(np.uint64)))
    starts = np.flatnonzero(row[:count] == row[least_match - 1 :])
    grams = words.shingles(own, least_match)[starts]
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    twice = np.zeros(len(starts), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    starts = starts[twice]
    if not len(starts):
        return out
    cover = np.zeros(len(hashed) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + least_match, -1)
    held = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    gap = np.ones(len(held), bool)
    gap[1:] = np.diff(held) > 1
    # The stretches, each followed by a rank of its own.
    ranks = np.unique(own[held], return_inverse=True)[1] + 1
    at = np.arange(len(held)) + np.cumsum(gap) - 1
    n_gaps = int(gap.sum())
    text = np.zeros(len(held) + n_gaps, np.int64)
    place = np.full(len(text), -1, np.int64)
    text[at], place[at] = ranks, held
    text[place < 0] = ranks.max() + 1 + np.arange(n_gaps)
    order = suffix_order(text)
    common = common_lengths(text.tolist(), order.tolist())
    left = np.full(len(hashed), -1, np.int64)
    inner = held[held > first[row[held]]]
    left[inner] = np.unique(hashed[inner - 1], return_inverse=True)[1]
    best: dict[tuple[int, int], int] = {}
    for i, distance, size in maximal_pairs(place[order].tolist(), common, left.tolist(), least_match, times):
        if size + distance >= least:
            key = (i, size + distance)
            best[key] = min(distance, best.get(key, distance))
    for (i, size), period in sorted(best.items(), key=lambda x: (x[0][0], x[1])):
        r = int(row[i])
        out[r].append((i - int(first[r]), size, period))
    return out


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length for its period, then the smallest start and period; runs come by start and period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def collapse_runs(docs: DataFrame, least: int = 24, times: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, n_words, runs, strongest and collapsed_text.

    A run is a stretch of consecutive words with smallest period q, of at least max(least, times * q) words, that no
    neighbouring word extends keeping the period (times is 3 or more). runs has start (words from 0), length and period,
    by start, then period; strongest is the one with the greatest length / period (null without a run; ties: smallest
    start, then period). collapsed_text has all words that no run holds beyond its first q words, joined by one space.
    Words are unchanged maximal runs without ASCII white space, compared as 64-bit hashes. A null or empty text has no
    words and no runs, and an empty collapsed_text. Ids may repeat or be null. Texts of any length are read whole, each in
    one task: memory is linear in its words, time is linear but for sorting and merging. Other columns are not read. An
    empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, bounds in words.groups(batch.column(1)):
                starts, ends, first = words.spans(data, bounds)
                found = runs_of(words.hashes(data, starts, ends, lower=False), first, least, times)
                raw, collapsed = data.tobytes(), []
                for runs, a, b in zip(found, bounds[:-1], bounds[1:], strict=True):
                    kept = raw[a:b].split()
                    if runs:
                        lost = np.zeros(len(kept) + 1, np.int64)
                        for start, length, period in runs:
                            lost[start + period] += 1
                            lost[start + length] -= 1
                        kept = [w for w, n in zip(kept, np.cumsum(lost).tolist()) if not n]
                    collapsed.append(b" ".join(kept).decode("utf-8", "replace"))
                named = lambda r: r and dict(zip(("start", "length", "period"), r, strict=True))
                columns = [pa.array(np.diff(first), pa.int64()), pa.array([[named(r) for r in runs] for runs in found], _RUNS), pa.array([named(strongest(runs)) for runs in found], _RUNS.value_type), pa.array(collapsed, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(found)), *columns], ["id", *_COLUMNS])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    one = "struct<start:long,length:long,period:long>"
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_words long, runs array<{one}>, strongest {one}, collapsed_text string"
    return rows.transform(map_texts, run, schema).select(F.col("id").alias(id_col), *_COLUMNS)


_COLUMNS = ["n_words", "runs", "strongest", "collapsed_text"]
