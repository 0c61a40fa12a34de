"""Queries of images: other grids, masks and atlases brought to a grid, slices that go down. Registered with those of catalogue.py."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespark.operators import clusters, lattice, partial_volume, resample, stages
from kinespark.plans import catalogue, proxies
from kinespark.plans.catalogue import CONFETTI, ORIGIN, ZOOM, query, r6
from kinespark.plans.proxies import sql
from kinespark.sources import nifti, tables
from kinespark.staging import stage_dir

#: The proxy image's voxels are cubes of 1.5 mm here, its first one away from the world's origin.
FINE, SHIFT = 1.5, (-7.0, 4.0, -20.5)
_SHAPE = "s AS (SELECT 8 AS nx, 8 AS ny, max(vec_id // 64) + 1 AS nz FROM embeddings)"


def grid(spark: SparkSession, d: str) -> resample.Grid:
    """The grid of the proxy lattice, by its highest voxel."""
    nz = int(proxies.lattice(spark, d).agg(F.max("z")).first()[0] or 0) + 1
    return resample.Grid((8, 8, nz), tuple(tuple([*(FINE if i == j else 0.0 for j in range(3)), SHIFT[i]]) for i in range(3)))


def _axis(c: str, size: float) -> str:
    """Target places along an axis of a grid of cubes, with the two source places that they weigh."""
    p = f"round(i * {size}e0 / {FINE}e0, 9)"
    return f"""{c}1 AS (SELECT i AS t{c}, CAST(floor({p}) AS BIGINT) AS lo, {p} - floor({p}) AS f FROM (SELECT unnest(range(0, CAST(ceil(round((n{c} - 1) * {FINE}e0 / {size}e0, 9)) AS BIGINT) + 1)) AS i, n{c} FROM s) WHERE {p} <= n{c} - 1),
{c}2 AS (SELECT t{c}, lo AS {c}, 1 - f AS w{c} FROM {c}1 WHERE f < 1 UNION ALL SELECT t{c}, lo + 1, f FROM {c}1 WHERE f > 0)"""


def _resampled_sql(size: int) -> str:
    axes = ",\n".join(_axis(c, size) for c in "xyz").replace("x1 ", f"x{size}1 ").replace("y1 ", f"y{size}1 ").replace("z1 ", f"z{size}1 ").replace("x2 ", f"x{size}2 ").replace("y2 ", f"y{size}2 ").replace("z2 ", f"z{size}2 ")
    return axes + f",\nr{size} AS (SELECT tx AS x, ty AS y, tz AS z, sum(wx * wy * wz * mean) AS mean FROM x{size}2 JOIN xyz USING (x) JOIN y{size}2 USING (y) JOIN z{size}2 USING (z) JOIN mn USING (vox_id) GROUP BY tx, ty, tz)"


_MEAN = "mn AS (SELECT vox_id, avg(activity) AS mean FROM vox GROUP BY vox_id)"


@query(sql("vox", "xyz") + f",\n{_SHAPE}, {_MEAN},\n" + ",\n".join(_resampled_sql(n) for n in (2, 3, 4)) + """
SELECT how, x, y, z, round(mean, 6) AS mean FROM (SELECT '2mm' AS how, * FROM r2 UNION ALL SELECT '3mm', * FROM r3 UNION ALL SELECT '4mm', * FROM r4
  UNION ALL SELECT '2x', x // 2, y // 2, z // 2, avg(mean) FROM xyz JOIN mn USING (vox_id) GROUP BY 2, 3, 4)""")
def q_resampled_image(spark, d):
    cells = proxies.lattice(spark, d).join(catalogue.image_mass(spark, d), "vox_id").withColumnRenamed("mass", "mean")
    out = None
    for how in ("2mm", "3mm", "4mm", "2x"):
        found = resample.for_clustering(cells.select("x", "y", "z", "mean"), grid(spark, d), how, "mean")[0]
        found = found.select(F.lit(how).alias("how"), *[F.col(c).cast("long").alias(c) for c in "xyz"], r6(F.col("mean"), "mean"))
        out = found if out is None else out.unionByName(found)
    return out


@query(sql("vox", "xyz") + f""", {_SHAPE}, ck AS (SELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, frame, avg(activity) AS activity FROM vox JOIN xyz USING (vox_id) WHERE z >= 1 GROUP BY 1, 2, 3, frame),
mk AS (SELECT DISTINCT x, y, z - 2 AS z FROM xyz WHERE label < 4 AND z >= 2),
ms AS (SELECT DISTINCT x // 2 AS x, y // 2 AS y, z // 2 AS z FROM mk WHERE x % 2 = 0 AND y % 2 = 0 AND z % 2 = 0)
SELECT frame, round(avg(activity), 6) AS activity, count(*) AS voxel_count FROM (SELECT vec_id AS vox_id, x // 2 AS x, y // 2 AS y, z // 2 AS z FROM (SELECT vec_id, vec_id % 8 AS x, (vec_id // 8) % 8 AS y, vec_id // 64 - 2 AS z FROM embeddings) WHERE x % 2 = 0 AND y % 2 = 0 AND z >= 0 AND z % 2 = 0) b
JOIN ms USING (x, y, z) JOIN vox USING (vox_id) GROUP BY frame""")
def q_override_resampled(spark, d):
    """The mean curve of a mask in full resolution, over data that were clipped by two slices and then made coarser."""
    whole = grid(spark, d)
    clipped = whole.clipped(2)
    data = resample.halved(clipped)
    cells = lattice.clip_axial(proxies.lattice(spark, d), 2)
    coarse = resample.nearest(cells.select("vox_id", "x", "y", "z"), clipped, data)
    mask = resample.mask_on(proxies.lattice(spark, d).where("label < 4").select("x", "y", "z"), whole, data)
    curve = stages.overridden(catalogue._centroids(spark, d).limit(0), proxies.voxels(spark, d).join(coarse, "vox_id"), coarse.join(mask, ["x", "y", "z"], "left_semi").select("vox_id"))
    return curve.select("frame", r6(F.col("activity"), "activity"), "voxel_count")


@query(sql("clu", "xyz") + """, lo AS (SELECT k, clu.label, x, y, z - 1 AS z FROM clu JOIN xyz USING (vox_id) WHERE z >= 1 AND x % 2 = 0 AND y % 2 = 0 AND (z - 1) % 2 = 0),
s AS (SELECT 8 AS n, max(vec_id // 64) AS nz FROM embeddings), up AS (SELECT unnest(range(0, 8)) AS tx), uz AS (SELECT unnest(range(0, nz)) AS tz FROM s)
SELECT k, label, CAST(tx AS BIGINT) AS x, CAST(b.ty AS BIGINT) AS y, CAST(tz + 1 AS BIGINT) AS z FROM lo JOIN up a ON least(floor(a.tx / 2e0 + 0.5e0), 3) * 2 = x AND a.tx <= 6 JOIN (SELECT tx AS ty FROM up) b ON floor(b.ty / 2e0 + 0.5e0) * 2 = y AND b.ty <= 6
JOIN uz ON floor(tz / 2e0 + 0.5e0) * 2 = z AND tz <= (SELECT 2 * ((nz + 1) // 2 - 1) FROM s)""")
def q_atlas(spark, d):
    """Clusters of coarse data as masks of the whole image: brought to the clipped image's grid, clipped slices put back, written and read again."""
    cropped = grid(spark, d).clipped(1)
    coarse = resample.halved(cropped)
    cells = lattice.clip_axial(proxies.lattice(spark, d).drop("label"), 1).where("x % 2 = 0 AND y % 2 = 0 AND z % 2 = 0")
    cells = cells.withColumns({c: F.floor(F.col(c) / 2) for c in "xyz"})
    atlas = resample.atlas_on(proxies.labels(spark, d).join(cells, "vox_id").select("k", "label", "x", "y", "z"), coarse, cropped, 1)
    path = f"{stage_dir(spark)}/masks"
    tables.write_masks(atlas.withColumn("bucket", F.lit("all")), path, again=True)
    return spark.read.parquet(path).select(F.col("k").cast("long").alias("k"), F.col("label").cast("long").alias("label"), "x", "y", "z")


_DOWN = CONFETTI.replace("xyz AS (SELECT vec_id AS vox_id, label, vec_id % 8 AS x, (vec_id // 8) % 8 AS y, vec_id // 64 AS z FROM embeddings)", "xyz AS (SELECT vec_id AS vox_id, label, vec_id % 8 AS x, (vec_id // 8) % 8 AS y, (SELECT max(vec_id // 64) FROM embeddings) - vec_id // 64 AS z FROM embeddings)")
_DOWN = _DOWN.replace(f"sum(z * m) / sum(m) * {ZOOM}e0 + {ORIGIN}e0", f"sum(z * m) / sum(m) * -{ZOOM}e0 + {-ORIGIN}e0").replace(f"- {ORIGIN}e0) / {ZOOM}e0", f"- {-ORIGIN}e0) / -{ZOOM}e0").replace("10 AS floor", f"{int(lattice.NOISE_SLICE * -ZOOM - ORIGIN)} AS floor")
_DOWN = _DOWN.replace("z BETWEEN lo AND hi", "z BETWEEN hi AND lo").replace("z < weak", "z > weak").replace("z < strong", "z > strong").replace("z < floor", "z > floor")


@query(_DOWN + "SELECT k, label, round(score, 6) AS score, score > 0 AS likely_confetti FROM cft")
def q_confetti_down(spark, d):
    """Scores of an image whose first slice is the highest, as its affine says."""
    top = grid(spark, d).shape[2] - 1
    cells = proxies.lattice(spark, d).drop("label").withColumn("z", F.lit(top) - F.col("z"))
    affine = [[ZOOM, 0, 0, 0], [0, ZOOM, 0, 0], [0, 0, -ZOOM, -ORIGIN]]
    axis, direction = lattice.superior_axis((8, 8, top + 1), affine)
    center = lattice.center_of_mass(cells.join(catalogue.image_mass(spark, d), "vox_id"), [], "mass").select(F.col(f"com_{'xyz'[axis]}").alias("image_z"))
    return _scored(proxies.labels(spark, d).join(cells, "vox_id"), center, axis, direction, affine)


_SIGMA = (0.7, 0.7, 0.9)
_KERNELS = ", ".join(f"{c}k AS (SELECT unnest({list(range(-(len(k) // 2), len(k) // 2 + 1))}) AS d{c}, unnest([{', '.join(repr(float(w)) + ('' if 'e' in repr(float(w)) else 'e0') for w in k)}]) AS w{c})" for c, k in zip("xyz", map(partial_volume.kernel, _SIGMA)))


@query(sql("vox", "xyz") + f""", {_KERNELS}, ke AS (SELECT * FROM xk CROSS JOIN yk CROSS JOIN zk), msk AS (SELECT vox_id, x, y, z FROM xyz WHERE label < 5),
nb AS (SELECT a.vox_id, b.vox_id AS near, b.label < 5 AS inside, wx * wy * wz AS w FROM msk a CROSS JOIN ke JOIN xyz b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz),
sh AS (SELECT vox_id, sum(w) AS share FROM nb WHERE inside GROUP BY vox_id),
sp AS (SELECT nb.vox_id, frame, sum(w * activity) AS spill FROM nb JOIN vox ON vox.vox_id = near WHERE NOT inside GROUP BY nb.vox_id, frame),
co AS (SELECT vox.vox_id, vox.frame, (activity - coalesce(spill, 0)) / share AS activity FROM vox JOIN sh USING (vox_id) LEFT JOIN sp ON sp.vox_id = vox.vox_id AND sp.frame = vox.frame),
cu AS (SELECT frame, avg(activity) AS activity, stddev_pop(activity) AS sd, count(*) AS voxel_count FROM co GROUP BY frame)
SELECT frame, round(activity, 6) AS activity, round(sd, 6) AS sd, voxel_count FROM cu
UNION ALL SELECT 0, 0, 0, (SELECT max(voxel_count) FROM cu) WHERE (SELECT arg_min(frame, (-activity, frame)) = min(frame) FROM cu)""")
def q_partial_volume(spark, d):
    cells = proxies.voxels(spark, d).select("vox_id", "frame", "activity").join(proxies.lattice(spark, d), "vox_id")
    mask = proxies.lattice(spark, d).where("label < 5").select("x", "y", "z")
    found = partial_volume.region_curve(partial_volume.corrected(cells, mask, grid(spark, d).shape, _SIGMA))
    return found.select("frame", r6(F.col("activity"), "activity"), r6(F.col("sd"), "sd"), "voxel_count")


@query(sql("vox", "xyz") + """SELECT CAST(frame AS INT) AS frame, CASE WHEN frame = 21 THEN 'ignored' WHEN frame > 23 THEN 'late' ELSE 'used' END AS use, CAST(z AS INT) AS z, round(sum(activity), 6) AS total, 1.5e0 AS size_x, count(*) FILTER (WHERE activity <> 0) AS n
FROM vox JOIN xyz USING (vox_id) WHERE frame BETWEEN 20 AND 25 GROUP BY 1, 2, 3""")
def q_image_scan(spark, d):
    """The voxels as a scan of one file a frame, with the affine that most of their headers have; six frames of it read again."""
    cells = proxies.voxels(spark, d).join(proxies.lattice(spark, d).drop("label"), "vox_id")
    here, path = grid(spark, d), f"{stage_dir(spark)}/scan-{uuid.uuid4().hex}"
    nifti.write_scan(cells, path, here.shape, [v for row in here.affine for v in row])
    affine = nifti.majority_affine(nifti.headers(spark, path)).first()["affine"]
    rows = nifti.read_scan(spark, path, first=20, last=25, late=23, ignored=(21,)).where("activity <> 0")
    found = rows.groupBy("frame", "use", "z").agg(F.sum("activity").alias("total"), F.count("*").alias("n"))
    return found.select("frame", "use", "z", r6(F.col("total"), "total"), F.lit(float(affine[0])).alias("size_x"), "n")


def _scored(cells: DataFrame, center: DataFrame, axis: int, direction: int, affine: list[list[float]]) -> DataFrame:
    found = clusters.confetti_of(cells, ["k", "label"], center, axis, direction, affine[axis][axis], affine[axis][3])
    return found.withColumn("score", F.round("score", 6))
