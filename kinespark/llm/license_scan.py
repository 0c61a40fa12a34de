"""License scans: a generalised suffix automaton of licence templates, matching statistics of whole files, chained matches.

The templates are a parameter of fixed size, so each Python worker builds the automaton once. A file is streamed through it;
matches of MIN_MATCH words or more that can't be extended are chained, per template, in the order of both texts, and a
chain that covers enough of its template is a span. Stretches in which MIN_MATCH consecutive words aren't all words of
templates hold no such match, so only the others are streamed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinespark.llm import words
from kinespark.llm._common import map_texts
from kinespark.llm.suffix_automaton import SuffixAutomaton

#: The least words of a match; the most words of a file between two matches of one chain.
MIN_MATCH, GAP = 4, 40
#: A chain gives its label if it covers this share of its template; a phrase alone gives a file this score.
LEAST_SHARE, PHRASE_SCORE = 0.6, 0.5
#: Phrases whose places are counted, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Public licence texts and notices by label (fixed values), without names and years.
TEMPLATES = {
    "mit": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "SPDX-License-Identifier: MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of
        the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software.""",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "SPDX-License-Identifier: Apache-2.0",
        """you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
        OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License",
        "SPDX-License-Identifier: GPL-3.0",
        "SPDX-License-Identifier: GPL-2.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT
        ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    ],
    "bsd": [
        "Licensed under the BSD License",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions
        of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the
        above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    ],
    "isc": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
        notice and this permission notice appear in all copies.""",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc": [
        "This work is licensed under a Creative Commons Attribution",
        "licensed under the Creative Commons Attribution",
    ],
}

#: Bytes that stand between words: ASCII other than letters and digits.
BETWEEN = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])

Span = tuple[int, int, int, int]  # template, first word of the file, word after the last, template words covered


class Templates:
    """The automaton, with the places in templates where each state's strings end, and the vocabulary."""

    def __init__(self, templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]]) -> None:
        cut = lambda text: [int(h) for h in _hashed(pa.array([text]))[1]]
        texts = [cut(text) for _, text in templates]
        self.labels, self.sizes = [label for label, _ in templates], [len(t) for t in texts]
        self.phrases = [(label, np.array(cut(phrase), np.uint64)) for phrase, label in phrases]
        self.vocabulary = np.unique(np.array([w for t in texts for w in t], np.uint64))
        self.automaton, self.places = SuffixAutomaton(), defaultdict(list)
        ends = [(i, k, state) for i, t in enumerate(texts) for k, state in enumerate(self.automaton.add(t), 1)]
        for i, k, state in ends:
            while state > 0 and self.automaton.length[state] >= MIN_MATCH:
                self.places[state].append((i, k))
                state = self.automaton.link[state]

    def matches(self, hashed: list[int], start: int) -> Iterator[tuple[int, int, int, int]]:
        """(template, word after the match in it, first word in the file, word after) of the matches that can't be extended."""
        before = (0, 0)
        for i, now in enumerate([*self.automaton.walk(hashed), (0, 0)]):
            state, size = before
            if size >= MIN_MATCH and now[1] <= size:
                for template, end in self.places[state]:
                    yield template, end, start + i - size, start + i
            before = now


@lru_cache(2)
def _built(templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...]) -> Templates:
    return Templates(templates, phrases)


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's first word (one entry more than texts), and all words' hashes, A-Z lower-cased."""
    data, bounds = words.flat(texts)
    starts, ends, first = words.spans(data, bounds, BETWEEN)
    return first, words.hashes(data, starts, ends, lower=True)


def chains(matches: list[tuple[int, int, int, int]]) -> list[Span]:
    """Chains of one template's matches, heaviest first, each match in one of them at most.

    A chain's matches rise in both texts; a file has GAP words at most between two of them, so that only the matches just
    before are asked for. Words that two matches share count once.
    """
    matches = sorted(matches, key=lambda m: (m[3], m[1]))
    best, last = [], []
    for k, (_, end, low, high) in enumerate(matches):
        found, at = high - low, -1
        for j in range(k - 1, -1, -1):
            _, before, first, after = matches[j]
            if after < low - GAP:
                break
            shared = max(0, after - low, before - (end - high + low))
            if first < low and before < end and before - (after - first) < end - (high - low) and (sum_ := best[j] + high - low - shared) > found:
                found, at = sum_, j
        best.append(found)
        last.append(at)
    used, out = [False] * len(matches), []
    for k in sorted(range(len(matches)), key=lambda k: (-best[k], k)):
        if used[k]:
            continue
        at, weight = k, best[k]
        while at >= 0 and not used[at]:
            used[at], first = True, at
            at = last[at]
        if at >= 0:
            weight -= best[at]
        out.append((matches[k][0], matches[first][2], matches[k][3], weight))
    return out


def spans_of(found: Templates, hashed: np.ndarray) -> list[Span]:
    """The chained template spans of one file, given its words' hashes, that cover LEAST_SHARE of their templates."""
    if len(hashed) < MIN_MATCH:
        return []
    known = np.zeros(len(hashed) + 2, bool)
    at = np.minimum(np.searchsorted(found.vocabulary, hashed), len(found.vocabulary) - 1)
    known[1:-1] = found.vocabulary[at] == hashed
    edge = np.flatnonzero(known[1:] != known[:-1])
    low, high = edge[::2], edge[1::2]
    by_template: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    for a, b in zip(low[high - low >= MIN_MATCH].tolist(), high[high - low >= MIN_MATCH].tolist(), strict=True):
        for match in found.matches(hashed[a:b].tolist(), a):
            by_template[match[0]].append(match)
    spans = [span for matches in by_template.values() for span in chains(matches)]
    return sorted((s for s in spans if s[3] >= LEAST_SHARE * found.sizes[s[0]]), key=lambda s: (s[1], s[0], s[2]))


def scan_licenses(docs: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    Words are maximal runs of ASCII letters (A-Z lower-cased), digits and characters beyond ASCII. n_base counts the places
    of all phrases, first_word and last_word are the least and greatest of their starts (null without one), base_labels
    their labels. spans has the template spans found (label, template's number, first word and word after the last in the
    file, template words covered, share of the template); labels has base_labels and the labels of spans. Both lists are
    distinct, sorted by code points and joined by commas. score is the greatest share of spans, PHRASE_SCORE at least where
    a phrase stands, else 0. A null or empty text has no word and scores 0. Ids may repeat or be null. Texts of any length
    are read whole, in memory and time in proportion to their words. Other columns are not read. An empty table gives an
    empty result.
    """
    listed = tuple((label, text) for label, texts in templates.items() for text in texts)
    asked = tuple(phrases.items())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _built(listed, asked)
        for batch in batches:
            for at, data, bounds in words.groups(batch.column(1)):
                starts, ends, first = words.spans(data, bounds, BETWEEN)
                hashed, n = words.hashes(data, starts, ends, lower=True), len(bounds) - 1
                row = words.rows_of(first)
                n_base, low, high = np.zeros(n, np.int64), np.full(n, len(hashed), np.int64), np.full(n, -1, np.int64)
                base: list[set[str]] = [set() for _ in range(n)]
                for label, phrase in found.phrases:
                    places = _places(hashed, row, phrase)
                    inside, rows = places - first[row[places]], row[places]
                    n_base += np.bincount(rows, minlength=n)
                    np.minimum.at(low, rows, inside)
                    np.maximum.at(high, rows, inside)
                    for i in np.unique(rows).tolist():
                        base[i].add(label)
                spans = [spans_of(found, hashed[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                labels = [base[i] | {found.labels[s[0]] for s in spans[i]} for i in range(n)]
                shares = [[s[3] / found.sizes[s[0]] for s in x] for x in spans]
                scores = [max([PHRASE_SCORE if b else 0.0, *x]) for b, x in zip(base, shares, strict=True)]
                out = [[{"label": found.labels[t], "template": t, "first": a, "after": b, "covered": c, "share": share} for (t, a, b, c), share in zip(x, y, strict=True)] for x, y in zip(spans, shares, strict=True)]
                join = lambda sets: pa.array([",".join(sorted(s)) for s in sets], pa.string())
                columns = [pa.array(np.diff(first), pa.int64()), pa.array(n_base), pa.array(low, mask=n_base == 0), pa.array(high, mask=n_base == 0), join(base), join(labels), pa.array(scores, pa.float64()), pa.array(out, _SPANS)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), *columns], ["id", *_COLUMNS])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,template:int,first:long,after:long,covered:int,share:double>>"
    return rows.transform(map_texts, scan, schema).select(F.col("id").alias(id_col), *_COLUMNS)


_COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("first", pa.int64()), ("after", pa.int64()), ("covered", pa.int32()), ("share", pa.float64())]))


def _places(hashed: np.ndarray, row: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """The words at which the phrase starts within one text."""
    n = len(phrase)
    if len(hashed) < n:
        return np.zeros(0, np.int64)
    hit = row[: len(row) - n + 1] == row[n - 1 :]
    for k, word in enumerate(phrase):
        hit &= hashed[k : len(hashed) - n + 1 + k] == word
    return np.flatnonzero(hit)
