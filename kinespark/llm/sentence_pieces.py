"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and lossless decoding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinespark.llm import words
from kinespark.llm._common import map_texts

#: Log-weight of a piece of rank r: -log(r + RANK_OFFSET); of one byte of a character that is no piece: BYTE_WEIGHT.
RANK_OFFSET, BYTE_WEIGHT = 300.0, -15.0
#: Sharpness of the sampling: piece log-weights are multiplied by it.
ALPHA = 0.25
#: The lattice of a chunk of up to so many characters is kept as a table row for each of its ends; so many rows are kept.
TABLE_CHARS, TABLE_ROWS = 32, 1 << 18
#: About so many bytes of whole texts are drawn and checked at once.
GROUP_BYTES = 1 << 18
#: Chunks of so many characters are drawn together, and so many new ends are filtered together.
PART_CHARS, FILTER_ENDS = 1 << 17, 1 << 15
#: A longer chunk is filtered in blocks of so many ends, of which one at a time is held.
BLOCK_ENDS = 1 << 15
MARK = "▁"
#: What stands for a character that is no piece until it is written as bytes: BYTES + its code point.
BYTES = 1 << 22

#: Leading bits of a hash that choose its slot.
SLOT_BITS = 18
_SLOT_SHIFT = np.uint64(64 - SLOT_BITS)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """A base to the powers 0 to n - 1, and their inverses modulo 2^64."""
    base = 0x5851F42D4C957F2D
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, x, np.uint64), dtype=np.uint64)]) for x in (base, pow(base, -1, 1 << 64)))


#: As long as anything that is hashed at once: a block with what stands before it, a chunk of a table, a piece.
_POWERS, _INVERSES = _powers(BLOCK_ENDS + 4096)


def _points(texts: list[str], width: int) -> np.ndarray:
    """Code points, a row a text, filled up with zeros."""
    size = np.array([len(t) for t in texts])
    out = np.zeros((len(texts), width), np.uint32)
    out[np.arange(width) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _sums(points: np.ndarray) -> np.ndarray:
    """Sums of hashed characters before each place (places x texts) of texts given a row each."""
    sums = np.zeros((points.shape[1] + 1, len(points)), np.uint64)
    np.cumsum(words.mix(points.T.astype(np.uint64)) * _POWERS[: points.shape[1], None], axis=0, out=sums[1:])
    return sums


def _substrings(sums: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n characters from each place of each text (places x texts)."""
    return (sums[n:] - sums[:-n]) * _INVERSES[: len(sums) - n, None]


class Pieces:
    """Pieces of one length by hash: a slot for each leading SLOT_BITS bits says where the hashes that have them begin."""

    def __init__(self, hashed: np.ndarray, ids: np.ndarray, weights: np.ndarray) -> None:
        order = np.argsort(hashed)
        self.hashed, self.ids, self.weights = hashed[order], ids[order], weights[order]
        at, first, count = np.unique((self.hashed >> _SLOT_SHIFT).astype(np.int64), return_index=True, return_counts=True)
        self.slots = np.zeros(1 << SLOT_BITS, np.min_scalar_type(len(hashed)))
        self.slots[at] = first + 1
        self.most = int(count.max())

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these hashes are pieces, by their place in the flat array, and the number of each one's piece here."""
        slot = self.slots[(wanted >> _SLOT_SHIFT).view(np.int64)].ravel()
        place = np.flatnonzero(slot)  # few others pass
        key, at = wanted.ravel()[place], slot[place].astype(np.int64) - 1
        for _ in range(self.most - 1):
            at = np.minimum(at + (self.hashed[at] != key), len(self.hashed) - 1)
        hit = self.hashed[at] == key
        return place[hit], at[hit]


class Vocabulary:
    """The pieces of a model file with their weights. A piece's mark for white space stands as a space in it."""

    def __init__(self, path: str, alpha: float) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.size, self.ids, self.weights, self.first_byte = n, {}, {}, {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.first_byte[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text = piece.replace(MARK, " ")
                if MARK not in text.replace(" ", "") and " " not in text.lstrip(" "):
                    self.ids[text] = i
                    self.weights[text] = float(np.exp(-alpha * np.log(max(0.0, -model.get_score(i)) + RANK_OFFSET)))
        # Pieces by length, for looking many substrings up at once.
        self.by_length = {}
        for n in sorted({len(p) for p in self.ids}):
            pieces = [p for p in self.ids if len(p) == n]
            self.by_length[n] = Pieces(_substrings(_sums(_points(pieces, n)), n)[0], np.array([self.ids[p] for p in pieces], np.int32), np.array([self.weights[p] for p in pieces]))
        self.byte_ids = np.array([self.first_byte[b] for b in range(256)], np.int32)
        self.byte_weight = float(np.exp(alpha * BYTE_WEIGHT))
        self.longest = max(map(len, self.ids))

    def ending(self, text: str, end: int) -> list[tuple[int, int, float]]:
        """The (length, id, weight) of the pieces that end at this place of the text, the shortest first; bytes if no piece is the character."""
        found = [(n, self.ids[p], self.weights[p]) for n in range(1, min(end, self.longest) + 1) if (p := text[end - n : end]) in self.ids]
        return found if found and found[0][0] == 1 else [(1, BYTES + ord(text[end - 1]), self.byte_weight), *found]


def spelled(path: str) -> list[bytes]:
    """What each piece of a model file spells, by id; nothing for pieces that spell none."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    none = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(model.get_piece_size())]
    pieces = map(model.id_to_piece, range(len(none)))
    return [b"" if no else bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode() for i, (p, no) in enumerate(zip(pieces, none, strict=True))]


def _uniform(seed: np.ndarray, place: np.ndarray, step: int | np.ndarray) -> np.ndarray:
    """A number in [0, 1) that depends on a row's seed, the chunk's place in the row and the step in the chunk alone."""
    return (words.mix(seed ^ words.mix((place.astype(np.uint64) << np.uint64(32)) + np.asarray(step, np.uint64))) >> np.uint64(11)).astype(float) * 2.0**-53


def _digests(chars: np.ndarray, offset: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each chunk: chars has the characters of all, offset each one's place in its chunk, first where chunks begin."""
    return np.add.reduceat(words.mix(chars.astype(np.uint64) << np.uint64(32) | offset.astype(np.uint64)), first)


def _ragged(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places start to start + size of each entry, one after the other; how far each is in its entry; where entries begin."""
    first = np.cumsum(size) - size
    offset = np.arange(int(size.sum())) - np.repeat(first, size)
    return np.repeat(start, size) + offset, offset, first


class Chunks:
    """The chunks whose lattices are kept, by hash: first row and size of each, and how often it was met.

    A slot has one chunk, the latest; one that has lost its slot is learned again if it is met again.
    """

    def __init__(self) -> None:
        self.slots = np.zeros(1 << SLOT_BITS, np.int32)  # of number + 1
        self.n, self.digest, self.row, self.size, self.met = 0, *(np.zeros(0, t) for t in (np.uint64, np.int32, np.int32, np.int32))

    def __getitem__(self, chunk: str) -> int:
        points = _points([chunk], len(chunk))[0]
        number = int(self.find(_digests(points, np.arange(len(points)), np.zeros(1, np.int64)))[0])
        if number < 0:
            raise KeyError(chunk)
        return int(self.row[number])

    def find(self, digest: np.ndarray) -> np.ndarray:
        """The number of each one's chunk, -1 where there is none."""
        number = self.slots[(digest >> _SLOT_SHIFT).view(np.int64)] - 1
        if not self.n:
            return number
        return np.where(self.digest[number] == digest, number, -1)

    def put(self, digest: np.ndarray, row: np.ndarray, size: np.ndarray, met: np.ndarray) -> None:
        """More chunks, after those that are here."""
        self.digest, self.row, self.size, self.met = (np.concatenate([a[: self.n], b], dtype=a.dtype) for a, b in ((self.digest, digest), (self.row, row), (self.size, size), (self.met, met)))
        self.slots[(digest >> _SLOT_SHIFT).view(np.int64)] = np.arange(self.n, len(self.digest)) + 1
        self.n = len(self.digest)


class Lattices:
    """The lattices of the chunks that a worker has met, as the cumulative backward probabilities at each end of each chunk."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        # Filled up with ones to whole groups of eight, which sample() counts at once.
        self.cumulative = np.ones((TABLE_ROWS, -(-vocabulary.longest // 8) * 8), np.float32)
        # The greatest number stands for a character that is no piece; points has the character at each end.
        kind = np.min_scalar_type(vocabulary.size)
        self.none = np.iinfo(kind).max
        self.pieces = np.zeros((TABLE_ROWS, vocabulary.longest), kind)
        self.points = np.zeros(TABLE_ROWS, np.uint32)
        self.base = Chunks()
        self.used = 0

    def matches(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of chunks given a row each, the ids and weights of the pieces that end at each place (places x lengths x chunks)."""
        v, (m, size) = self.vocabulary, points.shape
        sums = _sums(points)
        # Chunks are the last axis, so that each operation runs along many of them.
        ids = np.zeros((size, v.longest, m), self.pieces.dtype)
        weights = np.zeros(ids.shape)
        for n, pieces in v.by_length.items():
            if n <= size:
                place, at = pieces.find(_substrings(sums, n))
                start, chunk = np.divmod(place, m)
                ids[start + n - 1, n - 1, chunk] = pieces.ids[at]
                weights[start + n - 1, n - 1, chunk] = pieces.weights[at]
        none = weights[:, 0] == 0
        ids[:, 0][none] = self.none
        weights[:, 0][none] = v.byte_weight
        return ids, weights

    def filter(self, weights: np.ndarray, forward: np.ndarray) -> np.ndarray:
        """Forward filtering, end by end: weights become cumulative backward probabilities.

        forward holds the sums of the ends before (lengths x chunks, the nearest first; 0 where there is none). It is
        returned as it stands after the last end. Only ratios within the longest piece matter, so ends are scaled to 1 and
        nothing underflows.
        """
        longest, m = forward.shape
        sums = np.zeros((len(weights) + longest, m))
        sums[:longest] = forward[::-1]
        if m == 1:
            return self._filter_one(weights[:, :, 0], sums[:, 0])[:, None]
        for end, here in enumerate(weights, longest):
            here *= sums[end - longest : end][::-1]
            for k in range(1, longest):
                here[k] += here[k - 1]
            total = here[-1].copy()
            sums[end - longest : end] /= total
            here /= total
            sums[end] = 1
        return sums[-longest:][::-1].copy()

    def _filter_one(self, weights: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """filter() of one chunk with fewer operations: ends are scaled only where numbers get out of hand."""
        longest = self.vocabulary.longest
        for i in range(len(weights)):
            total = np.add.accumulate(np.multiply(weights[i], sums[i : i + longest][::-1], out=weights[i]), out=weights[i])[-1]
            sums[i + longest] = total
            if not 1e-90 < total < 1e90:
                sums[i + 1 : i + longest + 1] /= total
        weights /= weights[:, -1:].copy()
        last = sums[-longest:][::-1]
        return last / last[0]

    def start(self, m: int) -> np.ndarray:
        forward = np.zeros((self.vocabulary.longest, m))
        forward[0] = 1
        return forward

    def add(self, points: np.ndarray, size: np.ndarray) -> None:
        """The lattices of chunks that are given a row each, filled up with zeros; their rows must fit."""
        ids, weights = self.matches(points)
        self.filter(weights, self.start(len(points)))
        real = np.arange(points.shape[1]) < size[:, None]
        rows = slice(self.used, self.used + int(size.sum()))
        self.cumulative[rows, : self.vocabulary.longest] = weights.astype(np.float32).transpose(2, 0, 1)[real]
        self.pieces[rows] = ids.transpose(2, 0, 1)[real]
        self.points[rows] = points[real]
        self.used = rows.stop

    def learn(self, chunks: set[str]) -> None:
        """The lattices of these chunks, which have TABLE_ROWS characters together at most."""
        same = list(chunks)
        self.rows(_points(["".join(same)], sum(map(len, same)))[0], np.fromiter(map(len, same), np.int64, len(same)))

    def rows(self, chars: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The first table row of each chunk; chars has all their characters, TABLE_ROWS at most. Chunks that are new are added."""
        at, offset, first = _ragged(np.cumsum(size) - size, size)
        digest = _digests(chars, offset, first) if len(size) else np.zeros(0, np.uint64)
        number = self.base.find(digest)
        new = np.flatnonzero(number < 0)
        self.base.met += np.bincount(number[number >= 0], minlength=self.base.n)
        found, one, which, times = np.unique(digest[new], return_index=True, return_inverse=True, return_counts=True)
        one = new[one]
        need = int(size[one].sum())
        if self.used + need > TABLE_ROWS:
            number = self._keep(number, need)
        # By size, so that those which are filtered together are filled up little.
        order = np.argsort(size[one], kind="stable")
        start, sizes = first[one][order], size[one][order]
        row = np.empty(len(one), np.int64)
        row[order] = self.used + np.cumsum(sizes) - sizes
        lo = 0
        while lo < len(sizes):
            hi = lo + int(np.searchsorted(np.arange(1, len(sizes) - lo + 1) * sizes[lo:], FILTER_ENDS, "right"))
            hi = max(hi, lo + 1)
            width = np.arange(sizes[hi - 1])
            points = chars[np.minimum(start[lo:hi, None] + width, len(chars) - 1)]
            self.add(points * (width < sizes[lo:hi, None]), sizes[lo:hi])
            lo = hi
        self.base.put(found, row, size[one], times)
        out = np.empty(len(size), np.int64)
        out[number >= 0] = self.base.row[number[number >= 0]]
        out[new] = row[which]
        return out

    def _keep(self, number: np.ndarray, need: int) -> np.ndarray:
        """Makes room for need rows and returns the new numbers: these chunks stay, and those met most in half of the table; others go."""
        old = self.base
        now = np.zeros(old.n, bool)
        now[number[number >= 0]] = True
        order = np.lexsort((-old.met, ~now))
        fits = np.cumsum(old.size[order]) <= min(TABLE_ROWS - need, TABLE_ROWS // 2)
        stay = np.zeros(old.n, bool)
        stay[order] = fits
        stay |= now
        at = np.flatnonzero(stay)
        rows = _ragged(old.row[at].astype(np.int64), old.size[at])[0]
        for table in (self.cumulative, self.pieces, self.points):
            table[: len(rows)] = table.take(rows, 0)
        self.base, self.used = Chunks(), len(rows)
        self.base.put(old.digest[at], np.cumsum(old.size[at]) - old.size[at], old.size[at], old.met[at] // 2)
        return np.where(number >= 0, (np.cumsum(stay) - 1)[number], -1)

    def sample(self, base: np.ndarray, size: np.ndarray, seed: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward sampling of all occurrences together, a piece each at a step: pieces from the last to the first, and their numbers."""
        end, live, steps, count = size.copy(), np.arange(len(base)), [], np.zeros(len(base), np.int64)
        while len(live):
            row = base[live] + end[live] - 1
            u = _uniform(seed[live], place[live], len(steps)).astype(np.float32)
            # Each true value is a byte of 1: eight are added in one number, whose bytes the product sums in the highest.
            below = (self.cumulative.take(row, 0) <= u[:, None]).view(np.uint64)
            total = below[:, 0].copy()
            for k in range(1, below.shape[1]):
                total += below[:, k]
            n = (total * np.uint64(0x0101010101010101) >> np.uint64(56)).astype(np.int64)
            # u can round to 1: then the last piece that has a probability.
            if len(over := np.flatnonzero(n >= self.cumulative.shape[1])):
                n[over] = (self.cumulative[row[over]] < 1).sum(1)
            piece = self.pieces[row, n].astype(np.int32)
            none = piece == self.none
            piece[none] = BYTES + self.points[row[none]].astype(np.int32)
            steps.append((live, piece))
            count[live] += 1
            end[live] -= n + 1
            live = live[end[live] > 0]
        start = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        for t, (at, piece) in enumerate(steps):
            out[start[at] + count[at] - 1 - t] = piece
        return out, count


def sample_long(lattices: Lattices, chunk: np.ndarray, seed: np.ndarray, place: int) -> np.ndarray:
    """The pieces of one chunk that is too long for a table, as sample() draws them, in time linear in its length.

    Blocks of ends are filtered from first to last, of which the sums at their borders are kept; then each is filtered again,
    from last to first, and sampled. Memory is that of a block, and of 4 bytes a character and piece.
    """
    longest, none, size = lattices.vocabulary.longest, lattices.none, len(chunk)
    points = chunk[None]

    def block(at: int) -> tuple[np.ndarray, np.ndarray]:
        low = max(0, at - longest + 1)  # pieces that end in the block may start before it
        ids, weights = lattices.matches(points[:, low : at + BLOCK_ENDS])
        return ids[at - low :], weights[at - low :]

    borders = [lattices.start(1)]
    for at in range(0, size - BLOCK_ENDS, BLOCK_ENDS):
        borders.append(lattices.filter(block(at)[1], borders[-1]))
    out, end, step = [], size, 0
    for at in range((size - 1) // BLOCK_ENDS * BLOCK_ENDS, -1, -BLOCK_ENDS):
        ids, weights = block(at)
        lattices.filter(weights, borders.pop())
        cumulative, ids = weights[:, :, 0].astype(np.float32), ids[:, :, 0]
        u = _uniform(seed, np.array([place]), np.arange(step, step + min(BLOCK_ENDS, end - at))).astype(np.float32)
        found, first = [], step
        while end > at:
            row = cumulative[end - 1 - at]
            n = int(row.searchsorted(u[step - first], "right"))
            if n >= longest:
                n = int((row < 1).sum())
            piece = int(ids[end - 1 - at, n])
            found.append(BYTES + int(points[0, end - 1]) if piece == none else piece)
            end -= n + 1
            step += 1
        out.append(np.array(found, np.int32))
    return np.concatenate(out)[::-1]


def _as_bytes(vocabulary: Vocabulary, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces with each character that is none written as its bytes' pieces, and how many each has become."""
    at = np.flatnonzero(pieces >= BYTES)
    count = np.ones(len(pieces), np.int64)
    if not len(at):
        return pieces, count
    chars = (pieces[at] - BYTES).astype(np.uint32)
    count[at] = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
    raw = chars.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    out = np.repeat(pieces, count)
    out[np.repeat(pieces >= BYTES, count)] = vocabulary.byte_ids[np.frombuffer(raw, np.uint8)]
    return out, count


def _cut(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts, each with a space in front; where each chunk starts in them; how many chunks each text has.

    Chunks are newlines, and runs of neither spaces nor newlines with the run of spaces before, if any, or such a run alone.
    """
    points = np.frombuffer("".join([f" {t}" for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]]) if texts else np.zeros(0, np.int64)
    starts = points == 10
    starts[1:] |= starts[:-1].copy()
    space = points == 32
    starts[1:] |= space[1:] & ~space[:-1]
    starts[first] = True
    at = np.flatnonzero(starts)
    return points, at, np.diff(np.searchsorted(at, first), append=len(at))


def sample_texts(lattices: Lattices, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sampled piece ids of all texts, one after the other, and how many each text has."""
    points, chunk, per = _cut(texts)
    size = np.diff(chunk, append=len(points))
    seed, place = np.repeat(seeds, per), np.arange(len(size)) - np.repeat(np.cumsum(per) - per, per)
    short = size <= TABLE_CHARS
    # No part has more characters than the table has rows, whatever the texts' lengths.
    part = np.cumsum(size * short) // (min(PART_CHARS, TABLE_ROWS) - TABLE_CHARS)
    cuts = np.flatnonzero(np.diff(part, prepend=-1, append=part[-1] + 1 if len(part) else 0))
    found, count = [np.empty(0, np.int32)], np.zeros(len(size), np.int64)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        at = lo + np.flatnonzero(short[lo:hi])
        base = lattices.rows(points[_ragged(chunk[at], size[at])[0]], size[at])
        ids, count[at] = lattices.sample(base, size[at], seed[at], place[at])
        found.append(ids)
    pieces = np.concatenate(found)
    if not short.all():
        parts, at, start = [], 0, np.cumsum(count) - count
        for i in np.flatnonzero(~short):
            parts += [pieces[at : start[i]], sample_long(lattices, points[chunk[i] : chunk[i] + size[i]], seed[i : i + 1], int(place[i]))]
            at, count[i] = start[i], len(parts[-1])
        pieces = np.concatenate([*parts, pieces[at:]])
    out, became = _as_bytes(lattices.vocabulary, pieces)
    ends = np.concatenate([[0], np.cumsum(became)])[np.concatenate([[0], np.cumsum(count)])]
    return out, np.diff(ends[np.concatenate([[0], np.cumsum(per)])])


def _spell(table: pa.Array, pieces: pa.Array, ends: np.ndarray) -> Iterator[bytes]:
    """What each row's pieces spell, without the space in front; row i has the pieces from ends[i] to ends[i + 1]. table is of spelled()."""
    flat = table.take(pieces)
    cuts = np.frombuffer(flat.buffers()[1], np.int32, len(flat) + 1, flat.offset * 4)[ends].tolist()
    raw = (flat.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
    return (raw[a + 1 : b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))


def encode(docs: DataFrame, model_path: str, seed: int = 0, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), lossless_col: str | None = None) -> DataFrame:
    """The id and keep columns, and pieces: a sampled segmentation of each row's whole text, as ids of the model's vocabulary.

    A text is drawn with a probability in proportion to the product of its pieces' weights, given seed and id: the same
    row always gives the same pieces, wherever it is computed, and rows with equal ids and texts give equal ones. A text is
    cut before each run of spaces and around newlines, which no piece crosses, so chunks are drawn independently. A
    character that is no piece, the white space mark itself included, is written as bytes, and one space is put in front,
    so decode() restores every text. A chunk of any length is drawn in bounded memory (sample_long). A null text has null pieces, an empty one the pieces of the space in front. A null id
    is seeded by the seed alone. An empty table gives an empty result. With lossless_col, a boolean column of that name says
    of each row whether its pieces, decoded as decode() does, give back its text: true for a null text. It is found in the
    pass that draws them, so no second worker is needed and no text is sent back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Built for each task and let go after it: a worker that waits holds no tables.
        lattices = Lattices(Vocabulary(model_path, alpha))
        table = pa.array(spelled(model_path), pa.binary()) if lossless_col else None
        for batch in batches:
            for at, data, bounds in words.groups(batch.column(0), GROUP_BYTES):
                n, raw = len(bounds) - 1, data.tobytes()
                given = [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                texts = [x.decode("utf-8", "surrogatepass") for x in given]
                pieces, count = sample_texts(lattices, texts, words.mix(batch.column(1).slice(at, n).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
                ends, drawn = np.concatenate([[0], np.cumsum(count)]).astype(np.int32), pa.array(pieces, pa.int32())
                found = [pa.ListArray.from_arrays(pa.array(ends), drawn, mask=pc.is_null(batch.column(0).slice(at, n)))]
                if lossless_col:
                    found.append(pa.array([x == y for x, y in zip(_spell(table, drawn, ends), given, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*found, *[batch.column(i).slice(at, n) for i in sources]], [*made, *names])

    # A text that is kept is sent once: column 0 is what run() reads and what it gives back.
    columns = (id_col, *keep)
    names, made = [f"c{i}" for i in range(len(columns))], ["pieces", "lossless"] if lossless_col else ["pieces"]
    sent = [i for i, c in enumerate(columns) if c != text_col]
    sources = [2 + sent.index(i) if i in sent else 0 for i in range(len(columns))]
    rows = docs.select(F.col(text_col).alias("text"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("seed"), *[F.col(columns[i]).alias(names[i]) for i in sent])
    kinds = [rows.schema["text" if i == 0 else names[k]].dataType.simpleString() for k, i in enumerate(sources)]
    types = ["array<int>", "boolean"][: len(made)] + kinds
    out = rows.transform(map_texts, run, ", ".join(f"{n} {kind}" for n, kind in zip([*made, *names], types, strict=True)))
    return out.select(*[F.col(n).alias(c) for c, n in zip(columns, names, strict=True)], "pieces", *[F.col(c).alias(lossless_col) for c in made[1:]])


def decode(encoded: DataFrame, model_path: str, pieces_col: str = "pieces", out_col: str = "decoded") -> DataFrame:
    """encoded with the text that the pieces spell; null where they are null. Any ids of encode() give back its text exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(spelled(model_path), pa.binary())
        for batch in batches:
            lists = batch.column(0)
            at = 0
            while at < len(lists):
                part = lists.slice(at, 256)
                ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(part), 0).to_numpy())])
                texts = [None if null else x.decode("utf-8", "surrogatepass") for x, null in zip(_spell(table, part.flatten(), ends), pc.is_null(part).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), part, *[batch.column(1 + i).slice(at, 256) for i in range(len(names))]], ["text", "pieces", *names])
                at += 256

    rest = [c for c in encoded.columns if c not in (out_col, pieces_col)]
    names = [f"c{i}" for i in range(len(rest))]
    rows = encoded.select(F.col(pieces_col).alias("pieces"), *[F.col(f"`{c}`").alias(n) for c, n in zip(rest, names, strict=True)])
    kinds = {"pieces": rows.schema["pieces"].dataType.simpleString()} | {n: rows.schema[n].dataType.simpleString() for n in names}
    out = rows.transform(map_texts, run, "text string, " + ", ".join(f"{n} {kind}" for n, kind in kinds.items()))
    named = dict(zip(rest, names, strict=True)) | {pieces_col: "pieces"}
    return out.select(*[F.col(named[c]).alias(c) for c in encoded.columns if c != out_col], F.col("text").alias(out_col))
