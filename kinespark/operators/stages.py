"""Cluster stages composed of the operators: features, sparsity reduction, override by a mask, the second step, masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.operators import clusters, lattice
from kinespark.staging import stage


def written(df: DataFrame, name: str) -> DataFrame:
    """df in the shared folder, so that later plans read its rows instead of making them again."""
    return stage(df, name)


def features(centroid_curves: DataFrame, cells: DataFrame, image_center: DataFrame, zoom: float, origin: float) -> DataFrame:
    """All features of all clusters in one job: traits, confetti score, blob count, and the centre's shift from the image's.

    cells: (k, label, vox_id, x, y, z); image_center: one row of com_x, com_y, com_z in voxels. Places are given in
    millimetres: voxels are cubes of zoom, and the first slice is at origin.
    """
    keys = ["k", "label"]
    found = clusters.traits(centroid_curves)
    slices = lattice.density(cells, keys).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    image = F.broadcast(image_center.select(*[F.col(f"com_{c}").alias(f"image_{c}") for c in "xyz"]))  # one row
    scores = lattice.confetti(slices.crossJoin(image), keys, "total", **lattice.confetti_bounds(F.col("image_z"), zoom, origin))
    scores = scores.select(*keys, F.col("score").alias("confetti_score"), "likely_confetti")
    count = lattice.blob_sizes(lattice.blobs(cells, keys), keys).groupBy(*keys).agg(F.count("*").alias("blobs"))
    affine = [[zoom, 0, 0, 0], [0, zoom, 0, 0], [0, 0, zoom, origin]]
    centres = cells.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in "xyz"]).crossJoin(image)
    own, of_image = lattice.world(tuple(map(F.col, "xyz")), affine), lattice.world(tuple(F.col(f"image_{c}") for c in "xyz"), affine)
    shift = F.sqrt(sum((F.pow(a - b, 2) for a, b in zip(own, of_image, strict=True)), F.lit(0.0)))
    placed = centres.select(*keys, *[w.alias(f"com_{c}") for c, w in zip("xyz", own, strict=True)], shift.alias("com_shift"))
    return found.join(scores, keys).join(count, keys).join(placed, keys)


def reduced(cells: DataFrame, found: DataFrame, voxels: DataFrame, share: float = 0.95) -> DataFrame:
    """(k, label, frame, voxel_count, activity, reduced_ratio): the curves of vascular clusters without their small blobs.

    Blobs stay, the largest first, until those before one have over share of the voxels; reduced_ratio is how many times as
    many voxels the whole cluster has.
    """
    keys = ["k", "label"]
    vascular = found.where("vascular").select(*keys)
    blobs = lattice.blobs(cells.join(vascular, keys, "left_semi"), keys)
    kept = lattice.sparsity(lattice.blob_sizes(blobs, keys), keys, share).where("kept").select(*keys, "blob")
    left = blobs.join(kept, [*keys, "blob"], "left_semi").select(*keys, "vox_id")
    means = voxels.join(left, "vox_id").groupBy(*keys, "frame").agg(F.count("*").alias("voxel_count"), F.avg("activity").alias("activity"))
    whole = cells.groupBy(*keys).agg(F.count("*").alias("n"))
    return means.join(whole, keys).select(*keys, "frame", "voxel_count", "activity", (F.col("n") / F.col("voxel_count")).alias("reduced_ratio"))


def overridden(centroid_curves: DataFrame, voxels: DataFrame, mask: DataFrame) -> DataFrame:
    """centroid_curves with a cluster (k = 1, label = 1) that is the mean curve of a mask's voxels, in place of any such before."""
    own = voxels.join(mask, "vox_id", "left_semi").groupBy("frame").agg(F.avg("activity").alias("activity"), F.count("*").alias("voxel_count"))
    new = own.select(F.lit(1).alias("k"), F.lit(1).alias("label"), "frame", "activity", "voxel_count")
    return clusters.upsert(centroid_curves.select("k", "label", "frame", "activity", "voxel_count"), new, ["k", "label"])


def second_step(labels: DataFrame, best: DataFrame, second: DataFrame, voxels: DataFrame) -> DataFrame:
    """(label, frame, voxel_count, activity, sd): the curves of the second clustering (vox_id, label) within the best cluster of the first."""
    inside = labels.join(F.broadcast(best.select("k", "label")), ["k", "label"], "left_semi").select("vox_id")
    rows = second.join(inside, "vox_id", "left_semi").join(voxels.select("vox_id", "frame", "activity"), "vox_id")
    return rows.groupBy("label", "frame").agg(F.count("*").alias("voxel_count"), F.avg("activity").alias("activity"), F.coalesce(F.stddev_pop("activity"), F.lit(0.0)).alias("sd"))


def padded_masks(cells: DataFrame, slices: int) -> DataFrame:
    """The clusters' voxels back in the lattice from which so many lowest slices were cut."""
    return cells.withColumn("z", F.col("z") + slices)


def bucket() -> Column:
    """The folder of a cluster's mask, by the first of its traits that is true."""
    return F.when(F.col("vascular"), "vascular").when(F.col("irreversible"), "irreversible").when(F.col("noise"), "noise").otherwise("other")


def sd_parts(voxels: DataFrame, group: list[str], width: float = 2.0) -> DataFrame:
    """(group, part, frame, activity): mean curves of each group's voxels: all, those whose mean is over width sd above the
    group's (hi), and those as far below (lo)."""
    means = voxels.groupBy("vox_id", *group).agg(F.avg("activity").alias("mean"))
    edges = means.groupBy(*group).agg(F.avg("mean").alias("m"), F.stddev_pop("mean").alias("sd"))
    off, far = F.col("mean") - F.col("m"), F.lit(float(width)) * F.col("sd")
    parts = F.when(off > far, F.array(F.lit("hi"), F.lit("all"))).when(off < -far, F.array(F.lit("lo"), F.lit("all"))).otherwise(F.array(F.lit("all")))
    dealt = means.join(edges, group).select("vox_id", F.explode(parts).alias("part"))
    return voxels.join(dealt, "vox_id").groupBy(*group, "part", "frame").agg(F.avg("activity").alias("activity"))
