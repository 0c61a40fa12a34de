"""Exact Jaccard join of documents as shingle sets: pivots with regions, triangle-inequality windows, and recursion.

Almost all texts are at the greatest distance from each other, so pivots drawn at large would split nothing. Regions are
therefore seeded by signatures that every linked pair shares: the pivot of a signature is the most central document that
has it, and a document stands in the region of each of its signatures' pivots. Linked documents so share a region. Within
a region all are compared with the pivot; those linked with it are one class and need no more comparing among each other.
The others, the region's shell, are compared with the documents of the region that the triangle inequality allows: large
regions are split into parts, and shell documents go to every part.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinespark.llm import words
from kinespark.llm._common import attach_groups, attach_lists, components, map_texts, scratch, stage

#: Members that are compared with a pivot in one task; a pivot's set goes to as many tasks as its region needs.
REGION_ROWS = 2000
#: Shingles, about, of the shell documents and of the members that one task compares; cells, where it compares sketches.
PART_SHINGLES, PART_CELLS = 1_000_000, 8_000_000
#: Members whose sketches are compared with a pivot's in one task.
PART_MEMBERS = 4000
#: Cells of a sketch, at least: each has the parity of the number of shingles that fall in it, so cells that differ in two
#: sketches can't be more than the elements that are in one set only. A pair with too many is out; the others are compared
#: in full. A larger set has as many cells as shingles, about, else its sketch would tell it from none.
CELLS = 2048
#: Documents of a signature that stand in one part; signatures that some group of texts has twice, with more documents than
#: this in all such groups, are dealt by parts, so many signatures at most, those of most documents. Any other has a
#: document a group of texts (words.GROUP_BYTES) at most, or is rarer than so many hot ones.
PART_HOLDERS, HOT_SIGNATURES = 1000, 20_000


def shingle_sets(data: np.ndarray, bounds: np.ndarray, n: int) -> list[np.ndarray]:
    """Each text's set of n-word shingles as sorted 64-bit hashes; a text of fewer words has its whole sequence as one."""
    starts, ends, first = words.spans(data, bounds)
    hashed = words.hashes(data, starts, ends, lower=True)
    grams = words.shingles(hashed, n)
    return [np.unique(grams[a : b - n + 1]) if b - a >= n else words.shingles(hashed[a:b], b - a) if b > a else grams[:0] for a, b in zip(first[:-1], first[1:], strict=True)]


def most_apart(a: int, b: int, percent: int) -> int:
    """The most elements in one only of two sets with sizes up to a and b that have this similarity."""
    return (100 - percent) * (a + b) // (100 + percent)


def schemes(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(tag, buckets, spare) of the ways in which a set of size n is signed.

    Sets of sizes 2^c to 2^(c+1) - 1 share way (c, own); those near 2^(c+1) from below and above share way (c, across).
    With d elements apart at most, spare + 1 buckets of d + 1 + spare don't differ; so, if a set has no more than spare
    empty ones, one that isn't empty is equal in both.
    """

    def way(tag: int, a: int, b: int) -> tuple[int, int, int]:
        least = most_apart(a, b, percent) + 1
        return tag, least + 1 + least // 8, 1 + least // 8

    c = n.bit_length() - 1
    out = [way(4 * c, 2 ** (c + 1) - 1, 2 ** (c + 1) - 1)]
    for low in (c - 1, c):
        edge = 2 ** (low + 1)
        if low >= 0 and (100 * n >= percent * edge if low == c else percent * n <= 100 * (edge - 1)):
            out.append(way(4 * low + 1, edge - 1, 100 * (edge - 1) // percent))
    return out


def signatures(shingles: np.ndarray, percent: int) -> np.ndarray:
    """64-bit signatures of a set: two sets with the similarity share at least one."""
    n, out = len(shingles), []
    if not n:
        return shingles
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(shingles), dtype=np.uint64)])
    for tag, buckets, spare in schemes(n, percent):
        place = ((shingles >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        cuts = np.searchsorted(place, np.arange(buckets + 1, dtype=np.uint64))
        full = np.flatnonzero(np.diff(cuts))
        seed = words.mix(np.array([tag], np.uint64))
        out.append(words.mix((sums[cuts[full + 1]] - sums[cuts[full]]) ^ words.mix(full.astype(np.uint64) + seed)))
        if buckets - len(full) > spare:
            # Rare: sets with many empty buckets also meet by the shingles of their prefix in hash order.
            out.append(words.mix(shingles[: n - -(-percent * n // 100) + 1] ^ words.mix(seed + np.uint64(1))))
    return np.concatenate(out)


def sketch(shingles: np.ndarray) -> bytes:
    cells = max(CELLS, 1 << (len(shingles) - 1).bit_length())
    counts = np.bincount((shingles & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Sketches (64-bit words along the last axis) as those of so many words: cells that fall together add their parities."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


_OFTEN = pa.list_(pa.struct([("signature", pa.int64()), ("n", pa.int64())]))


def _described(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """id, n_shingles, set_key (128 bits), sketch and signatures of each row; often has the signatures that its group of texts has twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, bounds in words.groups(batch.column(1)):
                sets = shingle_sets(data, bounds, n)
                signed = [signatures(s, percent) for s in sets]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in signed])]).astype(np.int32)
                flat = np.concatenate(signed).view(np.int64) if signed else np.zeros(0, np.int64)
                keys = [blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                value, times = np.unique(flat, return_counts=True)
                again = [{"signature": v, "n": n} for v, n in zip(value[times > 1].tolist(), times[times > 1].tolist(), strict=True)]
                often = pa.array([again, *[None] * (len(sets) - 1)], _OFTEN)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([sketch(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), often], ["id", "n_shingles", "set_key", "sketch", "signatures", "often"])

    return docs.select("id", "text").transform(map_texts, run, f"id {docs.schema['id'].dataType.simpleString()}, n_shingles long, set_key binary, sketch binary, signatures array<long>, often array<struct<signature:long,n:long>>")


def _compare(docs: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """(pivot, member, common, pivot_size, member_size) of staged distinct pairs, from the documents' texts.

    Each document's set goes to its pivots' tasks, of REGION_ROWS members each, and the pivot's set first of all.
    """
    parts = pairs.groupBy("pivot").agg(F.count("*").alias("members")).withColumn("parts", F.ceil(F.col("members") / REGION_ROWS).cast("int"))
    parts = stage(parts, "regions")
    placed = attach_groups(pairs, parts, ["pivot"], "members").select(F.col("member").alias("id"), F.struct("pivot", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("member")).alias("to"))
    own = parts.select(F.col("pivot").alias("id"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("id", F.struct(F.col("id").alias("pivot"), "part", F.lit(False).alias("member")).alias("to"))
    # A document's list is as long as its signatures, or, for a pivot, as its region has parts.
    wanted = stage(placed.union(own).groupBy("id").agg(F.collect_set("to").alias("to")), "region-members")
    kind = docs.schema["id"].dataType.simpleString()

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, bounds in words.groups(batch.column(1)):
                sets = [s.tobytes() for s in shingle_sets(data, bounds, n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), pa.array(sets, pa.binary()), batch.column(2).slice(at, len(sets))], ["id", "shingles", "to"])

    sets = attach_lists(docs.select("id", "text"), wanted, "id", "to", 24).select("id", "text", "to").transform(map_texts, to_sets, f"id {kind}, shingles binary, to array<struct<pivot:{kind},part:int,member:boolean>>")
    rows = sets.select("id", "shingles", F.explode("to").alias("to")).select("to.pivot", "to.part", "to.member", "id", "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, own = None, None
        for batch in batches:
            pivots, member, ids = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
            found = []
            for i, raw in enumerate(batch.column(4)):
                shingles = np.frombuffer(raw.as_buffer(), np.uint64)
                if not member[i]:
                    pivot, own = pivots[i], shingles
                    continue
                assert pivots[i] == pivot, "a pivot's own row comes first"
                at = np.searchsorted(own, shingles)
                at[at == len(own)] = 0
                found.append((i, int((own[at] == shingles).sum()), len(own), len(shingles)))
            if found:
                rows = pa.array([x[0] for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), ids.take(rows), *[pa.array([x[k] for x in found], pa.int64()) for k in (1, 2, 3)]], ["pivot", "member", "common", "pivot_size", "member_size"])

    dealt = rows.repartition("pivot", "part").sortWithinPartitions("pivot", "part", "member")
    return dealt.transform(map_texts, compare, f"pivot {kind}, member {kind}, common long, pivot_size long, member_size long")


def _differing(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """pairs (pivot, member, pivot_size, member_size), staged, with apart: the cells in which their sketches differ."""
    kind = pairs.schema["pivot"].dataType.simpleString()
    parts = stage(pairs.groupBy("pivot").agg(F.count("*").alias("members")).withColumn("parts", F.ceil(F.col("members") / PART_MEMBERS).cast("int")), "sketch-regions")
    placed = attach_groups(pairs, parts, ["pivot"], "members")
    one = placed.join(sketches, placed["member"] == sketches["id"]).select("pivot", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("listed"), "member", "pivot_size", "member_size", "sketch")
    none = F.lit(0).cast("long")
    own = parts.join(sketches, parts["pivot"] == sketches["id"]).select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("listed"), F.col("pivot").alias("member"), none.alias("pivot_size"), none.alias("member_size"), "sketch")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            listed, apart = batch.column(2).to_pylist(), np.zeros(batch.num_rows, np.int64)
            for i, raw in enumerate(batch.column(6)):
                bits = np.frombuffer(raw.as_buffer(), np.uint64)
                if listed[i]:
                    words_in_both = min(len(bits), len(own))
                    apart[i] = np.bitwise_count(folded(bits, words_in_both) ^ folded(own, words_in_both)).sum()
                else:
                    own = bits.copy()
            keep = batch.column(2)
            yield pa.RecordBatch.from_arrays([*[batch.column(i).filter(keep) for i in (0, 3, 4, 5)], pa.array(apart).filter(keep)], ["pivot", "member", "pivot_size", "member_size", "apart"])

    dealt = one.unionByName(own).repartition("pivot", "part").sortWithinPartitions("pivot", "part", "listed")
    return dealt.transform(map_texts, compare, f"pivot {kind}, member {kind}, pivot_size long, member_size long, apart long")


def _dealt(members: DataFrame, load: str, most: int, percent: int) -> DataFrame:
    """members, staged, as rows of tasks (pivot, part, block, member): each member meets each shell document of its region once.

    A region has as many parts of members and blocks of shell documents as keep the sum of load in each to about most.
    Of a region with one root nothing is left, nor of members too near the pivot for any shell document.
    """
    shell = F.col("shell")
    regions = members.groupBy("pivot").agg(F.sum(load).alias("load"), F.sum(F.when(shell, F.col(load))).alias("shell_load"), F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.when(shell, F.coalesce("distance", F.lit(0.0)))).alias("nearest"))
    parts = stage(regions.where("low <> high AND shell_load > 0").select("pivot", "n", "nearest", *[F.ceil(F.col(c) / most).cast("int").alias(p) for c, p in (("load", "parts"), ("shell_load", "blocks"))]), "region-parts")
    reach = (100 - percent) / 100 + 1e-9
    inside = attach_groups(members, parts, ["pivot"], "n").where(shell | (F.col("distance") >= F.col("nearest") - reach))
    deal = lambda count: F.pmod(F.xxhash64("id"), count).cast("int")
    every = lambda count: F.sequence(F.lit(0), count - 1)
    columns = ["id", "pivot", "size", "root"]
    as_member = inside.select(*columns, deal(F.col("parts")).alias("part"), F.explode(every(F.col("blocks"))).alias("block"), F.lit(True).alias("member"))
    as_shell = inside.where("shell").select(*columns, F.explode(every(F.col("parts"))).alias("part"), deal(F.col("blocks")).alias("block"), F.lit(False).alias("member"))
    return as_member.unionByName(as_shell)


def _near_shell(members: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(pivot, id): the documents of regions whose sketches allow a link with another root, a shell document being one of the two."""
    kind = members.schema["id"].dataType.simpleString()
    cells = F.greatest(F.col("size"), F.lit(CELLS))
    dealt = _dealt(members.withColumn("cells", cells), "cells", PART_CELLS, percent).join(sketches, "id").select("pivot", "part", "block", "member", "id", "size", "root", "sketch")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, shells, tables = None, [], None
        for batch in batches:
            found = set()
            for pivot, part, block, member, ident, size, root, raw in zip(*[batch.column(i).to_pylist() for i in range(8)], strict=True):
                if place != (pivot, part, block):
                    place, shells, tables = (pivot, part, block), [], None
                if not member:
                    shells.append((ident, size, root, raw))
                    continue
                if tables is None:
                    tables = {}
                    for length in {len(x[3]) for x in shells}:
                        ids, sizes, roots, raws = zip(*[x for x in shells if len(x[3]) == length], strict=True)
                        tables[length // 8] = np.array(ids), np.array(sizes, np.int64), np.array(roots), np.frombuffer(b"".join(raws), np.uint64).reshape(len(raws), -1)
                own = np.frombuffer(raw, np.uint64)
                for length, (ids, sizes, roots, bits) in tables.items():
                    if not len(own) <= 2 * length <= 4 * len(own):  # sets of such sizes aren't linked
                        continue
                    least = min(length, len(own))
                    apart = np.bitwise_count(folded(bits, least) ^ folded(own, least)).sum(1).astype(np.int64)
                    near = np.flatnonzero(((100 + percent) * apart <= (100 - percent) * (sizes + size)) & (100 * np.minimum(sizes, size) >= percent * np.maximum(sizes, size)) & (roots != root))
                    if len(near):
                        found.add((pivot, ident))
                        found.update((pivot, x) for x in ids[near].tolist())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], batch.schema.field(f).type) for i, f in ((0, 0), (1, 4))], ["pivot", "id"])

    return dealt.repartition("pivot", "part", "block").sortWithinPartitions("pivot", "part", "block", "member").transform(map_texts, compare, f"pivot {kind}, id {kind}").distinct()


def _judged(compared: DataFrame, percent: int) -> DataFrame:
    union = F.col("pivot_size") + F.col("member_size") - F.col("common")
    return compared.select("pivot", "member", (100 * F.col("common") >= percent * union).alias("linked"), (1 - F.col("common") / union).alias("distance"))


def _shell_links(docs: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """(u, v): links between documents of different roots, of a region's shell with all its members.

    members, staged: (pivot, id, size, shell, distance, root), a document once a region. Of two roots that a task finds
    linked, it gives one link.
    """
    kind = docs.schema["id"].dataType.simpleString()
    to = ["pivot", "part", "block", "member", "root"]
    wanted = stage(_dealt(members, "size", PART_SHINGLES, percent).groupBy("id").agg(F.collect_set(F.struct(*to)).alias("to")), "shell-members")
    types = f"pivot:{kind},part:int,block:int,member:boolean,root:{kind}"

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, bounds in words.groups(batch.column(1)):
                sets = [s.tobytes() for s in shingle_sets(data, bounds, n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), pa.array(sets, pa.binary()), batch.column(2).slice(at, len(sets))], ["id", "shingles", "to"])

    sets = attach_lists(docs.select("id", "text"), wanted, "id", "to", 48).select("id", "text", "to").transform(map_texts, to_sets, f"id {kind}, shingles binary, to array<struct<{types}>>")
    rows = sets.select("id", "shingles", F.explode("to").alias("to")).select(*[f"to.{c}" for c in to], "id", "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, shells, index, told = None, [], None, set()
        for batch in batches:
            found = []
            lists = [batch.column(i).to_pylist() for i in range(6)]
            for pivot, part, block, member, root, ident, raw in zip(*lists, batch.column(6), strict=True):
                if place != (pivot, part, block):
                    place, shells, index, told = (pivot, part, block), [], None, set()
                shingles = np.frombuffer(raw.as_buffer(), np.uint64)
                if not member:
                    shells.append((ident, root, shingles.copy()))
                    continue
                if index is None:
                    size = np.array([len(x[2]) for x in shells], np.int64)
                    flat = np.concatenate([x[2] for x in shells]) if shells else np.zeros(0, np.uint64)
                    order = np.argsort(flat, kind="stable")
                    index = flat[order], np.repeat(np.arange(len(shells)), size)[order], size
                keys, owner, size = index
                low, high = np.searchsorted(keys, shingles, "left"), np.searchsorted(keys, shingles, "right")
                per = high - low
                hit = np.repeat(low - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
                common = np.bincount(owner[hit], minlength=len(shells))
                for k in np.flatnonzero(100 * common >= percent * (size + len(shingles) - common)).tolist():
                    other, its_root = shells[k][:2]
                    if its_root != root and (pair := (min(root, its_root), max(root, its_root))) not in told:
                        told.add(pair)
                        found.append((ident, other))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], batch.schema.field(5).type) for i in (0, 1)], ["u", "v"])

    dealt = rows.repartition("pivot", "part", "block").sortWithinPartitions("pivot", "part", "block", "member")
    return dealt.transform(map_texts, compare, f"u {kind}, v {kind}")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, n_shingles, component_id (the smallest id that links reach, itself included).

    Words are maximal runs without ASCII white space, A-Z lower-cased. Two documents are linked if 100 times the size of
    their sets' intersection is at least percent times that of their union; a document without words is linked with
    nothing. Rows with equal sets are one class, compared once. Shingles stand as 64-bit hashes, sets' keys have 128 bits.
    Ids must be unique (rows that repeat id and text count as one); a row with a null id has a null component. Texts of any
    length are read whole; a text's set, 8 bytes a shingle, is in one task at a time. Other columns are not read. An empty
    table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    with scratch(docs.sparkSession):
        with scratch(docs.sparkSession):
            described, placed, seeded, sketches = _regions(rows, n, percent)
        roots = _roots(rows, seeded, sketches, n, percent)
        sized = placed.groupBy("first_id").agg(F.first("copies").alias("copies"))
        named = sized.join(roots, sized["first_id"] == roots["node"], "left").select("first_id", "copies", F.coalesce("root", "first_id").alias("component"))
        ends = attach_groups(placed.select("id", "first_id"), stage(named, "class-roots"), ["first_id"], "copies").select("id", "component").distinct()
        out = described.join(ends, "id", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component"))
        out = stage(out, "components", keep=True)
    return out.select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"))


def _regions(rows: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(id, n_shingles) of all rows, (id, first_id, copies) of classes of equal sets, the regions' members, and sketches.

    Members are rows (signature, part, parts, id, size, holders, pivot, pivot_size). A signature's documents are counted and
    its most central one is chosen within its part; hot signatures have many parts, and there both come from aggregations
    that combine within tasks first.
    """
    described = stage(_described(rows, n, percent), "described")
    real = described.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0))
    classes = stage(real.groupBy("set_key").agg(F.min("id").alias("first_id"), F.count("*").alias("copies")), "set-classes")
    placed = stage(attach_groups(real.select("id", "set_key"), classes, ["set_key"], "copies").select("id", "first_id", "copies"), "set-members", keep=True)
    copies = stage(placed.where(F.col("id") != F.col("first_id")).select("id", F.array().cast("array<int>").alias("none")), "set-copies")
    single = attach_lists(real.select("id", "n_shingles", "signatures"), copies, "id", "none", 0, "left_anti")
    signed = single.select("id", F.col("n_shingles").cast("int").alias("size"), F.explode("signatures").alias("signature"))
    hot = _hot_signatures(described, signed)
    dealt = signed.join(F.broadcast(hot), "signature", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), "parts"), F.lit(0)).cast("int"))
    # A hot signature's count is known; its parts' own counts aren't used, nor are their maxima.
    in_part = Window.partitionBy("signature", "part")
    shared = dealt.withColumn("holders", F.coalesce("n", F.count("*").over(in_part))).where("holders > 1")
    shared = stage(shared.select("signature", "id", "size", "holders", "part", F.coalesce("parts", F.lit(1)).cast("int").alias("parts")), "shared-signatures")
    # The most central: the original of many near copies shares more of its signatures than they do among each other.
    central = shared.join(shared.groupBy("id").agg(F.sum("holders").alias("degree")), "id")
    hot_first = central.where("parts > 1").groupBy("signature").agg(F.max(F.struct("degree", "id", "size")).alias("hot_first"))
    first = F.coalesce("hot_first", F.max(F.struct("degree", "id", "size")).over(in_part))
    seeded = central.join(F.broadcast(hot_first), "signature", "left").withColumn("first", first)
    seeded = stage(seeded.select("signature", "part", "parts", "id", "size", "holders", F.col("first.id").alias("pivot"), F.col("first.size").alias("pivot_size")).where("id <> pivot"), "seeded", keep=True)
    needed = seeded.select("id").union(seeded.select("pivot")).distinct()
    sketches = stage(described.select("id", "sketch").join(needed, "id", "left_semi").dropDuplicates(["id"]), "sketches", keep=True)
    return stage(described.select("id", "n_shingles"), "set-sizes", keep=True), placed, seeded, sketches


def _hot_signatures(described: DataFrame, signed: DataFrame) -> DataFrame:
    """(signature, n, parts), staged, of the signatures that are dealt by parts, HOT_SIGNATURES at most."""
    often = described.select(F.explode("often").alias("o")).groupBy("o.signature").agg(F.sum("o.n").alias("seen")).where(F.col("seen") > PART_HOLDERS)
    often = stage(often.orderBy(F.desc("seen"), "signature").limit(HOT_SIGNATURES).select("signature"), "often")
    counts = signed.join(F.broadcast(often), "signature", "left_semi").groupBy("signature").agg(F.count("*").alias("n"))
    # Copies of equal sets are seen, but don't hold.
    return stage(counts.where(F.col("n") > PART_HOLDERS).withColumn("parts", F.ceil(F.col("n") / PART_HOLDERS).cast("int")), "hot-signatures")


def _roots(rows: DataFrame, seeded: DataFrame, sketches: DataFrame, n: int, percent: int) -> DataFrame:
    """Each linked document's root (node, root)."""
    # A set much smaller than the other can't have the similarity; of such a pair no distance is known.
    fits = 100 * F.least("size", "pivot_size") >= percent * F.greatest("size", "pivot_size")
    pairs = seeded.where(fits).groupBy("pivot", F.col("id").alias("member")).agg(F.first("pivot_size").cast("long").alias("pivot_size"), F.first("size").cast("long").alias("member_size"))
    pairs = stage(pairs, "pairs")
    apart = stage(_differing(pairs, sketches), "apart")
    both, least = F.col("pivot_size") + F.col("member_size"), F.col("apart")
    near = apart.where((100 + percent) * least <= (100 - percent) * both)
    far = apart.where((100 + percent) * least > (100 - percent) * both).select("pivot", "member", F.lit(False).alias("linked"), (2 * least / (both + least)).alias("distance"))
    judged = stage(_judged(_compare(rows, stage(near.select("pivot", "member"), "near"), n), percent).unionByName(far), "judged")
    links = judged.where("linked").select(F.col("pivot").alias("u"), F.col("member").alias("v"))
    roots = components(links)
    # Of a pair that isn't linked, the distance may be a lower bound.
    known = judged.select("pivot", F.col("member").alias("id"), "linked", "distance")
    crowded = seeded.where("holders > 2").join(known, ["pivot", "id"], "left").withColumn("shell", ~F.coalesce("linked", F.lit(False)))
    opened = crowded.where("shell").select("signature", "parts").distinct().select("signature", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    crowded = crowded.join(opened, ["signature", "part"], "left_semi").groupBy("pivot", "id").agg(F.first("size").alias("size"), F.first("shell").alias("shell"), F.first("distance").alias("distance"))
    members = crowded.join(roots, crowded["id"] == roots["node"], "left").select("pivot", "id", "size", "shell", "distance", F.coalesce("root", "id").alias("root"))
    members = stage(members, "members")
    members = stage(members.join(_near_shell(members, sketches, percent), ["pivot", "id"], "left_semi"), "near-members")
    more = stage(_shell_links(rows, members, n, percent), "shell-links")
    if more.limit(1).count():
        return components(links.union(more))
    return roots
