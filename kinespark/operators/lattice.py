"""Voxels on a lattice (vox_id, x, y, z): layout, blocks, slices, centres, connected blobs, sparsity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.staging import scratch, stage


def voxel_id(x: Column, y: Column, z: Column, nx: int, ny: int) -> Column:
    """The place of a voxel in the matrix: slices outermost, then x, then y."""
    return z * (nx * ny) + x * ny + y


def voxel_xyz(vox_id: Column, nx: int, ny: int) -> tuple[Column, Column, Column]:
    return F.floor(vox_id / ny) % nx, vox_id % ny, F.floor(vox_id / (nx * ny))


def block_means(cells: DataFrame, value: str, by: int = 2, keys: list[str] | None = None) -> DataFrame:
    """The mean of each block of by cells along each axis, for each of keys; blocks at the edge are smaller."""
    return cells.groupBy(*(keys or []), *[F.floor(F.col(c) / by).alias(c) for c in "xyz"]).agg(F.avg(value).alias(value))


def clip_axial(cells: DataFrame, n: int) -> DataFrame:
    """Without the n first slices, counted from 0 again."""
    return cells.where(F.col("z") >= n).withColumn("z", F.col("z") - n)


def density(cells: DataFrame, keys: list[str], axis: int = 2) -> DataFrame:
    """How many voxels of each cluster stand in each slice (z) across the axis that superior_axis names."""
    return cells.groupBy(*keys, F.col("xyz"[axis]).alias("z")).agg(F.count("*").alias("n"))


#: Millimetres from the centre of mass: the range of vessels, and below which noise is weak, or strong; the slice at whose
#: height all below is noise.
VESSELS_BELOW, VESSELS_ABOVE, WEAK_BELOW, STRONG_BELOW, NOISE_SLICE = 33.6, 84.0, 31.9, 67.7, 10


def slice_of(world: Column, zoom: float, origin: float) -> Column:
    """The slice at a height in millimetres, for slices of zoom millimetres from origin on, cut towards 0."""
    return ((world - F.lit(float(origin))) / F.lit(float(zoom))).cast("int")


def confetti_bounds(com_z: Column, zoom: float, origin: float) -> dict[str, Column]:
    """The slices that confetti() weighs by, for an image with its centre of mass at this (fractional) slice.

    floor is the height in millimetres, not the slice, of NOISE_SLICE: scores were calibrated with it so.
    """
    com = com_z * F.lit(float(zoom)) + F.lit(float(origin))
    at = lambda mm: slice_of(com + F.lit(mm), zoom, origin)
    return {"low": at(-VESSELS_BELOW), "high": at(VESSELS_ABOVE), "weak": at(-WEAK_BELOW), "strong": at(-STRONG_BELOW), "floor": F.lit(int(NOISE_SLICE * zoom + origin))}


def confetti(slices: DataFrame, keys: list[str], total: str, low: Column, high: Column, weak: Column, strong: Column, floor: Column, direction: int = 1) -> DataFrame:
    """Each cluster's score: the share of its voxels in each slice times the slice's weight; over 0 means scattered.

    A slice weighs -5 from low to high, and, added up, 0.5 below weak, 1 below strong and 1 below floor. direction, of
    superior_axis, is -1 where slices go down: there, what is below has the larger number.
    """
    z = F.col("z") * direction
    low, high, weak, strong, floor = (c * direction for c in (low, high, weak, strong, floor))
    part = lambda cond, x: F.when(cond, x).otherwise(0.0)
    weight = part((z >= low) & (z <= high), -5.0) + part(z < weak, 0.5) + part(z < strong, 1.0) + part(z < floor, 1.0)
    return slices.groupBy(*keys).agg(F.sum(F.col("n") / F.col(total) * weight).alias("score")).withColumn("likely_confetti", F.col("score") > 0)


def world(place: tuple[Column, Column, Column], affine: list[list[float]]) -> list[Column]:
    """World coordinates of a voxel by the rows of its image's affine."""
    return [sum((F.lit(float(a)) * c for a, c in zip(row[:3], place, strict=True)), F.lit(float(row[3]))) for row in affine[:3]]


def world_corners(shape: DataFrame, affine: list[list[float]]) -> DataFrame:
    """The eight corners of an image of shape (nx, ny, nz) in world coordinates (corner, wx, wy, wz)."""
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("corner"), F.lit(i // 4).alias("cx"), F.lit(i // 2 % 2).alias("cy"), F.lit(i % 2).alias("cz")) for i in range(8)]))
    rows = shape.withColumn("c", corner).select("c.corner", *[(F.col(f"c.c{a}") * F.col(f"n{a}")).alias(a) for a in "xyz"])
    found = world((F.col("x"), F.col("y"), F.col("z")), affine)
    return rows.select("corner", *[w.alias(f"w{a}") for a, w in zip("xyz", found, strict=True)])


def superior_axis(shape: tuple[int, int, int], affine: list[list[float]]) -> tuple[int, int] | None:
    """(axis, 1) of the axis whose first slice is the lowest in the world, (axis, -1) if it is the highest; None if neither."""
    at = lambda place, row: sum(a * p for a, p in zip(row[:3], place, strict=True)) + row[3]
    ends = at((0, 0, 0), affine[2]), at(shape, affine[2])
    for axis in (2, 1, 0):
        middle = [n // 2 for n in shape]
        middle[axis] = 0
        height = at(middle, affine[axis])
        if height in (min(ends), max(ends)):
            return axis, 1 if height == min(ends) else -1
    return None


def center_of_mass(cells: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """(keys, com_x, com_y, com_z), null where the weights sum to 0."""
    return cells.groupBy(*keys).agg(*[F.try_divide(F.sum(F.col(c) * F.col(weight)), F.sum(weight)).alias(f"com_{c}") for c in "xyz"])


#: Voxels along each edge of a tile; a task has a tile's voxels of one key at once.
TILE = 32


def _inside(x: np.ndarray, y: np.ndarray, z: np.ndarray, gap: int) -> np.ndarray:
    """For each voxel of a tile the lowest number of a voxel that neighbours connect it with."""
    place = [c - c.min() + gap for c in (x, y, z)]
    size = [int(c.max()) + 1 + gap for c in place]
    flat = np.ravel_multi_index(place, size)
    spot, own = np.unique(flat, return_inverse=True)
    number = np.full(int(np.prod(size)), -1, np.int64)
    number[spot] = np.arange(len(spot))
    steps = np.arange(-gap, gap + 1)
    near = (steps[:, None, None] * size[1] + steps[None, :, None]) * size[2] + steps[None, None, :]
    pairs = [(np.flatnonzero(other >= 0), other[other >= 0]) for step in near.ravel().tolist() if step > 0 for other in [number[spot + step]]]
    a, b = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.int64) for i in (0, 1))
    root = np.arange(len(spot))
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (up := root[root] != root).any():
            root[up] = root[root[up]]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    least = np.full(len(spot), len(x), np.int64)
    np.minimum.at(least, root[own], np.arange(len(x)))
    return least[root[own]]


def _roots(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, blob, root): the least blob of the same keys that edges (keys, blob, other; staged, each both ways) reach."""
    spark = edges.sparkSession
    labels = stage(edges.groupBy(*keys, "blob").agg(F.least(F.col("blob"), F.min("other")).alias("root")), "roots")
    changed = True
    while changed:
        with scratch(spark):
            low = edges.join(labels.withColumnRenamed("blob", "other"), [*keys, "other"]).groupBy(*keys, "blob").agg(F.min("root").alias("low"))
            lower = stage(labels.join(low, [*keys, "blob"]).select(*keys, "blob", "root", F.least("root", "low").alias("new")), "lower")
            above = lower.select(*keys, F.col("blob").alias("new"), F.col("new").alias("above"))
            new = F.least("new", F.coalesce("above", "new"))
            labels = stage(lower.join(above, [*keys, "new"], "left").select(*keys, "blob", new.alias("root"), (F.col("root") != new).alias("changed")), "roots", keep=True)
        changed = bool(labels.where("changed").limit(1).count())
        labels = labels.select(*keys, "blob", "root")
    return labels


def blobs(cells: DataFrame, keys: list[str], gap: int = 1, tile: int = TILE) -> DataFrame:
    """cells (keys, vox_id, x, y, z) with blob: the least vox_id among the voxels of the same keys that neighbours connect.

    Neighbours differ by gap at most along each axis (26 of them at 1). Voxels are labelled within tiles first, each tile
    in one Arrow pass; then only voxels at the tiles' borders are joined with their neighbours, and the labels that meet
    there are merged in rounds that grow with the logarithm of the tiles that a blob spans. Rows with a null key have no
    blob and are left out.
    """
    names = [*keys, "vox_id", *"xyz"]
    real = F.lit(True)
    for c in names:
        real &= F.col(c).isNotNull()
    rows = cells.where(real).select(*names, *[F.floor(F.col(c) / tile).alias(f"tile_{c}") for c in "xyz"])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def label(table: pa.Table) -> pa.Table:
        table = table.sort_by("vox_id")  # so that the lowest number is the least vox_id
        x, y, z = (table.column(c).to_numpy().astype(np.int64) for c in "xyz")
        low = _inside(x, y, z, gap)
        edge = np.zeros(len(x), bool)
        for c in (x, y, z):
            edge |= (c % tile < gap) | (c % tile >= tile - gap)
        return table.select(names).append_column("blob", table.column("vox_id").take(pa.array(low))).append_column("edge", pa.array(edge))

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + f", blob {kinds['vox_id']}, edge boolean"
    with scratch(cells.sparkSession):
        found = stage(rows.groupBy(*keys, "tile_x", "tile_y", "tile_z").applyInArrow(label, schema), "tiles", keep=True)
        border = found.where("edge")
        around = border.select(*keys, "blob", *"xyz", *[F.floor(F.col(c) / tile).alias(f"tile_{c}") for c in "xyz"])
        for c in "xyz":
            around = around.withColumn("d", F.explode(F.array(*[F.lit(d) for d in range(-gap, gap + 1)]))).withColumn(c, F.col(c) + F.col("d")).drop("d")
        leaves = F.lit(False)
        for c in "xyz":
            leaves |= F.floor(F.col(c) / tile) != F.col(f"tile_{c}")
        met = around.where(leaves).join(border.select(*keys, *"xyz", F.col("blob").alias("other")), [*keys, *"xyz"]).where("blob <> other")
        met = stage(met.select(*keys, "blob", "other").distinct(), "met")
        if met.limit(1).count():
            roots = stage(_roots(met, keys), "blob-roots", keep=True)
            found = found.join(roots, [*keys, "blob"], "left").withColumn("blob", F.coalesce("root", "blob"))
    if set(cells.columns) == set(names):
        return found.select(*cells.columns, "blob")
    return cells.join(found.select(*keys, "vox_id", "blob"), [*keys, "vox_id"])


def blob_sizes(found: DataFrame, keys: list[str]) -> DataFrame:
    return found.groupBy(*keys, "blob").agg(F.count("*").alias("n"))


def sparsity(sizes: DataFrame, keys: list[str], share: float = 0.95) -> DataFrame:
    """sizes with prev_share (of the larger blobs before each) and kept: prev_share does not exceed share yet."""
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "blob").rowsBetween(Window.unboundedPreceding, -1)
    prev = F.coalesce(F.sum("n").over(order), F.lit(0)) / F.sum("n").over(Window.partitionBy(*keys))
    return sizes.withColumn("prev_share", prev).withColumn("kept", F.col("prev_share") <= share)


def sphere_ratio(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The share of each cluster's voxels within twice the radius of a ball of its size, about its centre."""
    stats = cells.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in "xyz"])
    radius = 2 * F.pow(3 * F.col("n") / (4 * F.pi()), F.lit(1 / 3))
    away = F.sqrt(sum((F.pow(F.col(c) - F.col(f"m{c}"), 2) for c in "xyz"), F.lit(0.0)))
    return cells.join(stats, keys).groupBy(*keys).agg(F.avg(F.when(away <= radius, 1.0).otherwise(0.0)).alias("ratio"))
