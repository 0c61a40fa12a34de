"""Token counts of whole texts: batch encoding inside Arrow functions that return lengths only."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinespark.llm import words
from kinespark.llm._common import map_texts

#: Bytes of one call of the tokenizer, and of the stretch of a long text that is split into words at once.
BATCH_BYTES = 1 << 18
STRETCH_BYTES = 4 << 20
SPACES = (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")
#: Words longer than this aren't remembered; so many are.
LONG_WORD, REMEMBERED = 64, 1_000_000


@lru_cache(4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found, {}


def _encode(tokenizer, texts: list[bytes]) -> Iterator[int]:
    """The token count of each text, in calls of about BATCH_BYTES."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= BATCH_BYTES):
            size += len(texts[to])
            to += 1
        yield from (len(x) for x in tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in texts[at:to]], add_special_tokens=False))
        at = to


def _stretches(text: bytes) -> Iterator[bytes]:
    """The text in stretches of STRETCH_BYTES at most that end before white space; a word that is longer is a stretch of its own."""
    at = 0
    while len(text) - at > STRETCH_BYTES:
        to = max(text.rfind(c, at + 1, at + STRETCH_BYTES) for c in SPACES)
        if to < 0:
            to = min((x for c in SPACES if (x := text.find(c, at + STRETCH_BYTES)) >= 0), default=len(text))
        yield text[at:to]
        at = to
    yield text[at:]


def lengths(path: str, texts: list[bytes]) -> list[int]:
    """Tokens of each text, for a tokenizer that drops white space: no token spans it, so a text has its words' tokens.

    Each distinct word is encoded once and its count remembered by the worker, up to REMEMBERED words.
    """
    if len(texts) == 1 and len(texts[0]) > STRETCH_BYTES:
        return [sum(_counted(path, [stretch])[0] for stretch in _stretches(texts[0]))]
    return _counted(path, texts)


def _counted(path: str, texts: list[bytes]) -> list[int]:
    tokenizer, known = _tokenizer(path)
    found = [text.split() for text in texts]
    wanted = set().union(*found)
    new = [w for w in wanted if w not in known]
    if len(known) + len(new) > REMEMBERED:
        known.clear()
        new = list(wanted)
    counts = dict(zip(new, _encode(tokenizer, new), strict=True))
    known.update(counts)
    out = [sum(map(known.__getitem__, x)) for x in found]
    for w in counts:
        if len(w) > LONG_WORD:
            del known[w]
    return out


def with_token_counts(docs: DataFrame, tokenizer_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    tokenizer_path names a tokenizers .json whose tokenizer drops white space (its normaliser and pre-tokenizer keep
    nothing across white space); texts are then split safely at any ASCII white space, very long ones in stretches of
    STRETCH_BYTES. A single word goes to the library whole, however long. A null text counts as empty.
    Special strings inside texts are handled as the library does by default. Ids may repeat or be null. Other columns are
    not read. An empty table gives an empty result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_tokens, n_bytes = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            # A text over the limit of a group is a group of its own, so lengths() has it alone.
            for at, data, bounds in words.groups(batch.column(1)):
                raw = data.tobytes()
                n_tokens[at : at + len(bounds) - 1] = lengths(tokenizer_path, [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
                n_bytes[at : at + len(bounds) - 1] = np.diff(bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(n_tokens)], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.transform(map_texts, count, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
