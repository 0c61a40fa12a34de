"""Vector code compression: product codebooks by member-resident Lloyd rounds, and codes of all vectors.

The table of members has a row for each vector and part position. It is partitioned by (position, entry, salt): an owner's
rows stand together in files of the shared folder, and a round reads them where they are. A round assigns each resident part
to its nearest entry; parts that keep their entry stay in the files that the round writes, and only parts whose entry changes
go through a shuffle, to their new owners. The owners' sums and counts give the next entries.

An entry's members are dealt by so many salts that one that has all rows of its position is no more than a part's share of
the work. The codebooks have a fixed size (entries times components), so they go to the driver and, as closures, to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.llm._common import attach_groups, map_texts
from kinespark.staging import scratch, stage

#: Components are multiplied by this and rounded down; beyond MOST they count as MOST, so that distances fit 64 bits.
SCALE, MOST = 256, 1 << 27
#: Bytes of members meant for one partition.
PART_BYTES = 64 << 20
#: Rows of parts that are compared at once.
BLOCK = 8192


@dataclass
class Codebooks:
    """entries[position, entry, component], 64-bit integers; moved has the parts that changed entry in each round."""

    entries: np.ndarray
    moved: list[int]

    def digest(self) -> str:
        """SHA-256 of all components in decimal by position, entry and place, joined by commas."""
        return sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each part (a row of integers) the nearest entry, the lower index at ties, and its squared distance."""
    index, distance = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    for at in range(0, len(parts), BLOCK):
        x = parts[at : at + BLOCK]
        most = max(int(np.abs(x).max()), int(np.abs(entries).max()))
        if 4 * most * most * x.shape[1] < 1 << 53:  # exact in floating point
            a, b = x.astype(np.float64), entries.astype(np.float64)
            d = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
        else:
            d = np.zeros((len(x), len(entries)), np.int64)
            for k in range(x.shape[1]):
                d += (x[:, k, None] - entries[None, :, k]) ** 2
        index[at : at + BLOCK] = d.argmin(1)
        distance[at : at + BLOCK] = d.min(1).astype(np.int64)
    return index, distance


def integers(vector: Column) -> Column:
    """The vector's components as integers; null if it, or one of them, is null or not finite."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x))
    scaled = F.transform(vector, lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(x.cast("double") * SCALE))).cast("int"))
    return F.when(finite, scaled)


def _whole(rows: DataFrame, id_col: str, vector_col: str, label_col: str | None, n_parts: int, n_entries: int) -> tuple[DataFrame, list[list[int]]]:
    """(id, label, label_none, v) of the rows that count, and the first n_entries vectors by id."""
    label = F.lit(None).cast("string") if label_col is None else F.col(label_col).cast("string")
    found = rows.select(F.col(id_col).alias("id"), F.coalesce(label, F.lit("")).alias("label"), label.isNull().alias("label_none"), integers(F.col(vector_col)).alias("v")).where(F.size("v") > 0)
    smallest = lambda df: [r["v"] for r in df.orderBy(F.asc_nulls_last("id"), "v").limit(n_entries).select("v").collect()]
    if first := smallest(found):
        if len(first[0]) % n_parts:
            raise ValueError(f"vectors of {len(first[0])} components can't be cut into {n_parts} equal parts")
        found = found.where(F.size("v") == len(first[0]))
        if any(len(v) != len(first[0]) for v in first):
            first = smallest(found)
    return found, first


def _assigned(members: DataFrame, entries: np.ndarray) -> DataFrame:
    """members (id, position, part, salt, entry) with the nearest entry, and moved: whether it is another one than before."""
    kind = members.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            position, before = batch.column("position").to_numpy(), batch.column("entry").to_numpy()
            part = batch.column("part").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(position), -1)
            entry = np.zeros(len(position), np.int32)
            for p in np.unique(position).tolist():
                here = position == p
                entry[here] = nearest(part[here], entries[p])[0]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "position", "part", "salt")), pa.array(entry), pa.array(entry != before)], ["id", "position", "part", "salt", "entry", "moved"])

    return members.select("id", "position", "part", "salt", "entry").transform(map_texts, run, f"id {kind}, position int, part array<int>, salt int, entry int, moved boolean")


def fit(vectors: DataFrame, n_parts: int = 16, n_entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> Codebooks | None:
    """Codebooks after so many Lloyd rounds over all vectors; None if no vector counts.

    They start as the parts of the n_entries smallest ids (fewer vectors make fewer entries; ties of ids by components). A
    round replaces each entry by the componentwise mean, rounded down, of the parts that are nearest to it (ties to the
    lower index); unused entries stay. Vectors that are null or hold a null or non-finite component don't count, nor do
    those of another length than the one with the smallest id. Repeated rows count as often as they stand.
    """
    spark = vectors.sparkSession
    found, first = _whole(vectors, id_col, vector_col, None, n_parts, n_entries)
    if not first:
        return None
    entries = np.array(first, np.int64).reshape(len(first), n_parts, -1).transpose(1, 0, 2)
    width = entries.shape[2]
    with scratch(spark):
        n_rows = found.count() * n_parts
        n_files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows * (32 + 4 * width) // PART_BYTES))
        salts = -(-n_files // (n_parts // 2 or 1))
        # The vector as a whole is in the hash, so that rows which share an id are dealt as well.
        cut = F.transform(F.sequence(F.lit(0), F.lit(n_parts - 1)), lambda p: F.struct(p.alias("position"), F.slice("v", p * width + 1, width).alias("part")))
        rows = found.select("id", F.pmod(F.xxhash64("id", "v"), F.lit(salts)).cast("int").alias("salt"), F.inline(cut)).withColumn("entry", F.lit(-1))
        members, moved = None, []
        for _ in range(rounds):
            with scratch(spark):
                # A part's first entry is a change, too.
                now = _assigned(rows if members is None else members, entries)
                now = now if members is None else stage(now, "assigned", keep=True)
                leaving = now.where("moved").drop("moved")
                arrived = stage(leaving.repartition(n_files, "position", "entry", "salt").sortWithinPartitions("position", "entry", "salt"), "arrived", keep=True)
                members = arrived if members is None else now.where("NOT moved").drop("moved").unionByName(arrived)
                moved.append(arrived.count())
            sums = members.groupBy("position", "entry").agg(F.count("*").alias("n"), *[F.sum(F.col("part")[k].cast("long")).alias(f"s{k}") for k in range(width)])
            entries = entries.copy()
            for r in sums.collect():  # n_parts * n_entries rows at most
                entries[r["position"], r["entry"]] = [r[f"s{k}"] // r["n"] for k in range(width)]
    return Codebooks(entries, moved)


def encode(vectors: DataFrame, books: Codebooks | None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """One row per row of vectors that counts: the id, code (each part's nearest entry in two hex digits or more), error, label_error.

    error sums the squared distances of the parts to their entries; label_error sums error over the rows of equal labels,
    null labels together (null where the sum exceeds 64 bits). Rows that don't count, as in fit(), give no row. Other columns are not read. An empty table,
    or one without a vector that counts, gives an empty result.
    """
    spark = vectors.sparkSession
    n_parts, n_entries, width = (1, 1, 1) if books is None else books.entries.shape
    found, _ = _whole(vectors, id_col, vector_col, label_col, n_parts, 0)
    found = found.where(F.size("v") == n_parts * width) if books is not None else found.limit(0)
    digits = max(2, len(f"{n_entries - 1:x}"))
    entries = None if books is None else books.entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([f"{i:0{digits}x}" for i in range(n_entries)])
        for batch in batches:
            v = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, n_parts, width)
            index, errors = zip(*(nearest(v[:, p], entries[p]) for p in range(n_parts)), strict=True)
            code = ["".join(row) for row in names[np.stack(index, 1)].tolist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(code, pa.string()), pa.array(np.sum(errors, 0))], ["id", "label", "label_none", "code", "error"])

    kind = found.schema["id"].dataType.simpleString()
    with scratch(spark):
        coded = stage(found.transform(map_texts, run, f"id {kind}, label string, label_none boolean, code string, error long"), "codes", keep=True)
        totals = stage(coded.groupBy("label", "label_none").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors", keep=True)
    joined = attach_groups(coded, totals, ["label", "label_none"], "n")
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error")


def compress(vectors: DataFrame, n_parts: int = 16, n_entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """fit(), then encode() with codebooks_sha256, the digest of the codebooks, added."""
    books = fit(vectors, n_parts, n_entries, rounds, id_col, vector_col)
    return encode(vectors, books, id_col, vector_col, label_col).withColumn("codebooks_sha256", F.lit(books.digest() if books else None).cast("string"))
