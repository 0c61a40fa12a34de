"""Separable Gaussian smoothing on the lattice, and the correction of one region's curve for what spills in and out of it.

The image is cut into blocks; a voxel goes to each block within reach of the kernel (a halo), so one shuffle suffices, and a
block is smoothed densely, one axis after the other, in one Arrow pass. No task has more than a block and its halo of one key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinespark.operators.resample import Grid

#: Voxels along each edge of a block; a kernel reaches so many standard deviations.
BLOCK, REACH = 32, 4.0


def kernel(sigma: float) -> np.ndarray:
    """Weights of the voxels around one, up to REACH standard deviations (of sigma voxels) away; they sum to 1."""
    r = int(REACH * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / max(sigma, 1e-9)) ** 2)
    return w / w.sum()


def deviations(grid: Grid, fwhm: float) -> tuple[float, float, float]:
    """The standard deviation in voxels along each axis of a scanner's blur, given its full width at half maximum in millimetres."""
    sizes = np.sqrt((grid.matrix()[:3, :3] ** 2).sum(0))
    return tuple(float(fwhm / np.sqrt(8 * np.log(2)) / s) for s in sizes)


def smoothed(cells: DataFrame, shape: tuple[int, int, int], sigma: tuple[float, float, float], value: str = "activity", keys: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """(keys, x, y, z, value): cells smoothed by a Gaussian; voxels without a row, and all beyond the image, count as 0.

    Has a row for each voxel of the image within the kernel's reach of a row. Rows that share keys and place are added up;
    null values count as 0.
    """
    keys = keys or []
    kernels = [kernel(s) for s in sigma]
    reach = [len(k) // 2 for k in kernels]
    rows = cells.select(*keys, *[F.col(c).cast("int").alias(c) for c in "xyz"], F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    for c, n, r in zip("xyz", shape, reach, strict=True):
        low, high = F.greatest(F.lit(0), F.floor((F.col(c) - r) / block)), F.least(F.lit((n - 1) // block), F.floor((F.col(c) + r) / block))
        rows = rows.where(F.col(c).between(0, n - 1)).withColumn(f"b{c}", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def smooth(table: pa.Table) -> pa.Table:
        at = [table.column(f"b{c}")[0].as_py() * block for c in "xyz"]
        place = [table.column(c).to_numpy().astype(np.int64) - a + r for c, a, r in zip("xyz", at, reach, strict=True)]
        size = [min(block, n - a) for n, a in zip(shape, at, strict=True)]
        cube = np.zeros([n + 2 * r for n, r in zip(size, reach, strict=True)])
        inside = np.ones(len(place[0]), bool)
        for p, n in zip(place, cube.shape, strict=True):
            inside &= (p >= 0) & (p < n)
        place = tuple(p[inside] for p in place)
        np.add.at(cube, place, table.column("v").to_numpy()[inside])
        near = np.zeros(cube.shape)
        near[place] = 1
        for axis, (k, n) in enumerate(zip(kernels, size, strict=True)):
            part = lambda a, i, n=n, axis=axis: np.take(a, np.arange(i, i + n), axis)
            cube = sum(w * part(cube, i) for i, w in enumerate(k))
            near = np.maximum.reduce([part(near, i) for i in range(len(k))])
        found = np.nonzero(near)
        n = len(found[0])
        named = [pa.array([table.column(c)[0].as_py()] * n, table.schema.field(c).type) for c in keys]
        return pa.Table.from_arrays([*named, *[pa.array((f + a).astype(np.int32)) for f, a in zip(found, at, strict=True)], pa.array(cube[found])], [*keys, *"xyz", value])

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], "x int", "y int", "z int", f"`{value}` double"])
    return rows.groupBy(*keys, "bx", "by", "bz").applyInArrow(smooth, schema)


def corrected(cells: DataFrame, mask: DataFrame, shape: tuple[int, int, int], sigma: tuple[float, float, float], frame: str = "frame", least: float = 0.05) -> DataFrame:
    """(frame, x, y, z, activity) inside a mask (x, y, z; one region): what blur took out given back, what it brought in taken out.

    A blurred voxel inside holds the region's activity times the blurred mask, plus what the blur brings from outside: the
    outside as it was measured, blurred again. So activity = (measured - blurred outside) / blurred mask. Where the blurred
    mask is under least, the region is too thin there to tell, and the voxel stays as it was measured.
    """
    inside = mask.select(*[F.col(c).cast("int").alias(c) for c in "xyz"]).distinct()
    rows = cells.select(frame, *[F.col(c).cast("int").alias(c) for c in "xyz"], "activity")
    spill = smoothed(rows.join(inside, [*"xyz"], "left_anti"), shape, sigma, "activity", [frame]).withColumnRenamed("activity", "spill")
    share = smoothed(inside.withColumn("share", F.lit(1.0)), shape, sigma, "share")
    found = rows.join(inside, [*"xyz"], "left_semi").join(share, [*"xyz"]).join(spill, [frame, *"xyz"], "left")
    given = (F.col("activity") - F.coalesce("spill", F.lit(0.0))) / F.col("share")
    return found.select(frame, *"xyz", F.when(F.col("share") >= least, given).otherwise(F.col("activity")).alias("activity"))


def region_curve(found: DataFrame, frame: str = "frame") -> DataFrame:
    """(frame, activity, sd, voxel_count) of a region's voxels; where the curve starts at its peak, a frame 0 of zeros comes first."""
    curve = found.groupBy(frame).agg(F.avg("activity").alias("activity"), F.stddev_pop("activity").alias("sd"), F.count("*").alias("voxel_count"))
    top = curve.agg(F.min_by(frame, F.struct(-F.col("activity"), F.col(frame))).alias("top"), F.min(frame).alias("first"), F.max("voxel_count").alias("n"))
    zero = top.where("top = first").select((F.col("first") - 1).alias(frame), F.lit(0.0).alias("activity"), F.lit(0.0).alias("sd"), F.col("n").alias("voxel_count"))
    return curve.unionByName(zero)
