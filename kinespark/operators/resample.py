"""Images on other grids: trilinear and nearest gathers by an affine, masks and atlases brought to another image's grid.

An image is a table of voxels (x, y, z and values); a voxel that has no row counts as 0. A grid is the image's shape and
affine: a few numbers, which become literals of the plan. Each target voxel explodes to the source corners that it weighs,
one equi-join finds their values, and one sum, partial before its shuffle, adds them up.
"""

from __future__ import annotations

import itertools
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespark.operators import lattice

#: Places are rounded to so many decimals of a voxel, so that one on an edge isn't outside it by rounding.
PLACES = 9


@dataclass(frozen=True)
class Grid:
    """An image's shape in voxels and its affine from voxels to millimetres (three rows of four, or four)."""

    shape: tuple[int, int, int]
    affine: tuple[tuple[float, ...], ...]

    def matrix(self) -> np.ndarray:
        return np.vstack([np.array(self.affine, float)[:3], [0, 0, 0, 1]])

    def clipped(self, slices: int) -> Grid:
        """Without so many lowest slices; the others stay where they are in the world."""
        m = self.matrix()
        m[:3, 3] += m[:3, 2] * slices
        return Grid((*self.shape[:2], self.shape[2] - slices), _rows(m))


def _rows(matrix: np.ndarray) -> tuple[tuple[float, ...], ...]:
    return tuple(tuple(float(v) for v in row) for row in matrix[:3])


def in_millimetres(grid: Grid, size: float) -> Grid:
    """The grid of cubes of size millimetres along the world's axes that covers the image's voxel centres, from their least corner on."""
    to_target = np.diag([1 / size] * 3 + [1.0]) @ grid.matrix()
    corners = np.array([[*c, 1] for c in itertools.product(*[(0, n - 1) for n in grid.shape])]) @ to_target.T
    low, high = corners[:, :3].min(0), corners[:, :3].max(0)
    affine = np.diag([size] * 3 + [1.0])
    affine[:3, 3] = low * size
    return Grid(tuple(int(n) + 1 for n in np.ceil(np.round(high - low, PLACES))), _rows(affine))


def halved(grid: Grid, by: int = 2) -> Grid:
    """The grid of lattice.block_means: blocks of by voxels, from the same first place on."""
    m = grid.matrix()
    m[:3, :3] *= by
    return Grid(tuple(-(-n // by) for n in grid.shape), _rows(m))


def _corners(target: DataFrame, source: Grid, grid: Grid, linear: bool) -> DataFrame:
    """target (x, y, z of grid) as tx, ty, tz with each source voxel x, y, z that it weighs by w; none if it lies outside."""
    m = np.linalg.inv(source.matrix()) @ grid.matrix()
    at = [F.round(sum((F.lit(float(a)) * F.col(c) for a, c in zip(m[i, :3], "xyz", strict=True)), F.lit(float(m[i, 3]))), PLACES) for i in range(3)]
    rows = target.select(*[F.col(c).alias(f"t{c}") for c in "xyz"], *[a.alias(f"p{c}") for a, c in zip(at, "xyz", strict=True)])
    inside = F.lit(True)
    for c, n in zip("xyz", source.shape, strict=True):
        inside &= F.col(f"p{c}").between(0, n - 1)
    rows = rows.where(inside)

    def along(c: str) -> Column:
        p = F.col(f"p{c}")
        if not linear:
            return F.array(F.struct(F.floor(p + 0.5).alias("at"), F.lit(1.0).alias("w")))
        low = F.floor(p)
        return F.array(F.struct(low.alias("at"), (1 - (p - low)).alias("w")), F.struct((low + 1).alias("at"), (p - low).alias("w")))

    for c in "xyz":
        rows = rows.withColumn(f"c{c}", F.explode(along(c))).where(F.col(f"c{c}.w") > 0)
    weight = F.col("cx.w") * F.col("cy.w") * F.col("cz.w")
    return rows.select("tx", "ty", "tz", *[F.col(f"c{c}.at").alias(c) for c in "xyz"], weight.alias("w"))


def voxels_of(spark: SparkSession, grid: Grid) -> DataFrame:
    """(x, y, z) of all voxels of a grid."""
    nx, ny, nz = grid.shape
    i = F.col("id")
    return spark.range(nx * ny * nz).select(F.floor(i / (ny * nz)).alias("x"), (F.floor(i / nz) % ny).alias("y"), (i % nz).alias("z"))


def resampled(cells: DataFrame, source: Grid, grid: Grid, value: str = "activity", keys: list[str] | None = None) -> DataFrame:
    """(keys, x, y, z, value) of cells (keys, x, y, z, value; on the source grid) on another grid, by trilinear weights.

    A voxel outside the centres of the source's outer voxels has no row, nor one that weighs no row of cells. Rows that
    share keys and place are added up; one with a null value, or with a null place, counts as 0.
    """
    spots = _corners(voxels_of(cells.sparkSession, grid), source, grid, linear=True)
    keys = keys or []
    found = cells.select(*keys, *[F.col(c).cast("long").alias(c) for c in "xyz"], F.col(value).alias(value)).join(spots, [*"xyz"])
    return found.groupBy(*keys, "tx", "ty", "tz").agg(F.coalesce(F.sum(F.col("w") * F.col(value)), F.lit(0.0)).alias(value)).select(*keys, *[F.col(f"t{c}").alias(c) for c in "xyz"], value)


def nearest(cells: DataFrame, source: Grid, grid: Grid) -> DataFrame:
    """cells (x, y, z and any columns; on the source grid), each as often as voxels of the other grid have it as their nearest.

    x, y, z become the places on the other grid. Voxels outside, as in resampled(), have no row.
    """
    spots = _corners(voxels_of(cells.sparkSession, grid), source, grid, linear=False).drop("w")
    rest = [c for c in cells.columns if c not in ("x", "y", "z")]
    found = cells.select(*rest, *[F.col(c).cast("long").alias(c) for c in "xyz"]).join(spots, [*"xyz"])
    return found.select(*rest, *[F.col(f"t{c}").alias(c) for c in "xyz"])


def for_clustering(cells: DataFrame, grid: Grid, how: str, value: str = "activity", keys: list[str] | None = None) -> tuple[DataFrame, Grid]:
    """cells and grid, coarser for clustering: how is 2mm, 3mm or 4mm (trilinear), 2x (means of blocks), or empty (as they are).

    Any other word is warned of and leaves them as they are.
    """
    if how in ("2mm", "3mm", "4mm"):
        coarse = in_millimetres(grid, float(how[0]))
        return resampled(cells, grid, coarse, value, keys), coarse
    if how == "2x":
        return lattice.block_means(cells, value, 2, keys), halved(grid)
    if how:
        warnings.warn(f"resampling by {how!r} isn't known; the data stay in their own resolution", stacklevel=2)
    return cells, grid


def clip_of(mask: Grid, data: Grid) -> int:
    """The lowest slices that a mask has and the data lack: of grids that differ in z alone, or by one ratio in x and y and another in z."""
    (mx, my, mz), (nx, ny, nz) = mask.shape, data.shape
    if (mx, my) == (nx, ny):
        return max(0, mz - nz)
    if mx > nx and my > ny and mz > nz and mx / nx == my / ny != mz / nz:
        return int(mz - mx / nx * nz)
    return 0


def mask_on(mask: DataFrame, grid: Grid, data: Grid) -> DataFrame:
    """mask (x, y, z of voxels inside) on the data's grid: first without the slices that were clipped, then, if it is finer, by nearest."""
    slices = clip_of(grid, data)
    mask, grid = lattice.clip_axial(mask, slices), grid.clipped(slices)
    if all(m > n for m, n in zip(grid.shape, data.shape, strict=True)):
        mask = nearest(mask, grid, data)
    return mask.where(F.col("x").between(0, data.shape[0] - 1) & F.col("y").between(0, data.shape[1] - 1) & F.col("z").between(0, data.shape[2] - 1))


def atlas_on(labelled: DataFrame, grid: Grid, cropped: Grid | None = None, slices: int = 0) -> DataFrame:
    """labelled (x, y, z and labels), brought from a coarse grid to the cropped image's by nearest, then with the clipped slices below it."""
    found = labelled if cropped is None else nearest(labelled, grid, cropped)
    return found.withColumn("z", F.col("z") + slices)
