"""Words of Arrow text columns in numpy: bounds, hashes, shingles, a group of documents at a time.

A word is a maximal run of characters other than the ASCII white space 0x20 and 0x09-0x0D, so bytes suffice to find it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once, and of words that are hashed at once: a worker keeps 16 bytes for each of the latter.
GROUP_BYTES, HASH_BYTES = 2 << 20, 1 << 16
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTERS = np.random.default_rng(20240607).integers(0, 2**64, 256, np.uint64)
_LOWER = _LETTERS.copy()
_LOWER[65:91] = _LETTERS[97:123]
_BASE = 0x5851F42D4C957F2D


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer (a bijection), so that all bits of the result depend on all bits of x."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE to the powers 0 to n - 1, and their inverses modulo 2^64."""
    base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, x, np.uint64), dtype=np.uint64)]) for x in (base, inverse))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and each text's bounds in them; a null counts as empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    bounds = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)).astype(np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]] if len(data) else data, bounds - bounds[0]


def groups(texts: pa.Array, limit: int = GROUP_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds) of consecutive rows that have about limit bytes together; one text is never cut."""
    if not len(texts):
        return
    data, bounds = flat(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield at, data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


def spans(data: np.ndarray, bounds: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's start and end in data, and for each text the number of its first word (one entry more than texts).

    between says of each byte whether it stands between words.
    """
    space = between[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    cuts = bounds[1:-1]
    before[cuts[cuts < len(data)]] = True
    after[cuts[cuts > 0] - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word, with A-Z taken as a-z if lower. Words of any length take memory for HASH_BYTES only."""
    out, letters, at = np.zeros(len(starts), np.uint64), _LOWER if lower else _LETTERS, 0
    most = min(HASH_BYTES, GROUP_BYTES)
    power, inverse = _powers(most)
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + most, "right")))
        first, n = int(starts[at]), int(ends[to - 1] - starts[at])
        if n > most:  # one long word: the same sum, a stretch at a time
            total, step = 0, pow(_BASE, most, 1 << 64)
            for k, low in enumerate(range(first, first + n, most)):
                part = letters[data[low : min(low + most, first + n)]]
                total += int((part * power[: len(part)]).sum(dtype=np.uint64)) * pow(step, k, 1 << 64)
            out[at] = mix(np.array([total % (1 << 64)], np.uint64) + np.array([n], np.uint64) * _STEP)[0]
        else:
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(letters[data[first : first + n]] * power[:n], out=sums[1:])
            s, e = starts[at:to] - first, ends[at:to] - first
            out[at:to] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * _STEP)
        at = to
    return out


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive words; the caller drops those that cross texts."""
    count = max(0, len(words) - n + 1)
    out = np.full(count, np.uint64(n))
    for k in range(n):
        out = mix(out * np.uint64(3) ^ words[k : k + count])
    return out


def rows_of(first: np.ndarray) -> np.ndarray:
    """For each word, the number of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
