"""Cluster curves: what kind of curve each is, which is the best, and how clusterings resemble each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.functions import curves
from kinespark.operators import lattice


def centroids(voxels: DataFrame, labels: DataFrame) -> DataFrame:
    """(k, label, frame, activity, voxel_count): the mean curve of each cluster. Partial sums are made before the shuffle."""
    return voxels.join(labels, "vox_id").groupBy("k", "label", "frame").agg(F.avg("activity").alias("activity"), F.count("*").alias("voxel_count"))


def traits(centroid_curves: DataFrame) -> DataFrame:
    """Of each cluster: peak, size, and the flags noise, irreversible, background, vascular.

    noise: any sample from the third on is negative; irreversible: the last sample is the highest; background: over a
    fifth of all voxels; vascular: none of these.
    """
    by = centroid_curves.groupBy("k", "label").agg(
        F.min_by(F.struct("frame", "activity"), F.struct(-F.col("activity"), F.col("frame"))).alias("top"), F.max_by("activity", "frame").alias("last"),
        F.bool_or((F.col("frame") > 2) & (F.col("activity") < 0)).alias("noise"), F.first("voxel_count").alias("voxel_count"),
    )
    all_voxels = F.sum("voxel_count").over(Window.partitionBy("k"))
    flagged = by.select("k", "label", (F.col("top.frame") - 1).alias("peak_index"), F.col("top.activity").alias("peak_value"), "voxel_count", "noise", (F.col("last") == F.col("top.activity")).alias("irreversible"), (F.col("voxel_count") > all_voxels / 5).alias("background"))
    return flagged.withColumn("vascular", ~F.col("noise") & ~F.col("irreversible") & ~F.col("background"))


def confetti_of(cells: DataFrame, keys: list[str], image_center: DataFrame, axis: int, direction: int, zoom: float, origin: float) -> DataFrame:
    """(keys, score, likely_confetti) of clusters of voxels (keys, x, y, z), along the axis and direction of lattice.superior_axis.

    image_center is one row with image_z, the image's centre of mass in slices; zoom is negative where slices go down.
    """
    slices = lattice.density(cells, keys, axis).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    rows = slices.crossJoin(F.broadcast(image_center))  # one row
    return lattice.confetti(rows, keys, "total", **lattice.confetti_bounds(F.col("image_z"), zoom, origin), direction=direction)


def best_in_k(found: DataFrame, confetti: DataFrame | None = None, keep_confetti: bool = False) -> DataFrame:
    """Of each k the vascular cluster that is the highest of those that peak first.

    confetti (k, label, likely_confetti), from lattice.confetti: clusters that are likely scattered are left out, unless
    keep_confetti. Without it no cluster is.
    """
    if confetti is not None and not keep_confetti:
        found = found.join(confetti.where("likely_confetti").select("k", "label"), ["k", "label"], "left_anti")
    order = Window.partitionBy("k").orderBy("peak_index", F.desc("peak_value"), "label")
    return found.where("vascular").withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def best_overall(best: DataFrame, peak_time: Column, limit: float = 10.0) -> DataFrame:
    """Among the best that peak before limit: the highest of those at the most frequent peak (the earliest, if several)."""
    early = best.where(peak_time < limit)
    mode = early.groupBy("peak_index").count().orderBy(F.desc("count"), "peak_index").limit(1).select("peak_index")
    return early.join(F.broadcast(mode), "peak_index").orderBy(F.desc("peak_value"), "k", "label").limit(1).select("k", "label", "peak_index", "peak_value")


def dice(labels: DataFrame) -> DataFrame:
    """(k1, label1, k2, label2, dice) of all clusters that share voxels, by counting them; a cluster with itself gives 1."""
    size = labels.groupBy("k", "label").agg(F.count("*").alias("n"))
    a, b = (labels.select(F.col("k").alias(f"k{i}"), F.col("label").alias(f"label{i}"), "vox_id") for i in (1, 2))
    shared = a.join(b, "vox_id").groupBy("k1", "label1", "k2", "label2").agg(F.count("*").alias("both"))
    s1, s2 = (size.select(F.col("k").alias(f"k{i}"), F.col("label").alias(f"label{i}"), F.col("n").alias(f"n{i}")) for i in (1, 2))
    joined = shared.join(s1, ["k1", "label1"]).join(s2, ["k2", "label2"])
    return joined.select("k1", "label1", "k2", "label2", (F.lit(2.0) * F.col("both") / (F.col("n1") + F.col("n2"))).alias("dice"))


def stability(similar: DataFrame) -> DataFrame:
    """Of each cluster: the mean over the other ks of the highest Dice there, and how many clusters of them have over a half."""
    other = similar.where("k1 <> k2")
    best = other.groupBy("k1", "label1", "k2").agg(F.max("dice").alias("best"), F.sum(F.when(F.col("dice") > 0.5, 1).otherwise(0)).alias("over"))
    return best.groupBy("k1", "label1").agg(F.avg("best").alias("stability"), F.sum("over").alias("overlapping"))


def matches_best(similar: DataFrame, best: DataFrame) -> DataFrame:
    """Of each cluster: its mean Dice with the best of each k (matches_best; one that shares no voxel counts as 0), and the
    clusters of other ks with a Dice over a half (overlapping: names label-k of two digits each, sorted)."""
    top = best.select(F.col("k").alias("k2"), F.col("label").alias("label2"), F.lit(True).alias("is_best"))
    rows = similar.join(F.broadcast(top), ["k2", "label2"], "left")  # a row a k
    over = F.when((F.col("k1") != F.col("k2")) & (F.col("dice") > 0.5), F.format_string("%02d-%02d", F.col("label2"), F.col("k2")))
    found = rows.groupBy("k1", "label1").agg(F.coalesce(F.sum(F.when(F.col("is_best"), F.col("dice"))), F.lit(0.0)).alias("match"), F.sort_array(F.collect_list(over)).alias("overlapping"))
    count = best.agg(F.count("*").alias("n_best"))
    shared = F.when(F.col("n_best") > 0, F.col("match") / F.col("n_best")).otherwise(0.0)
    return found.crossJoin(F.broadcast(count)).select(F.col("k1").alias("k"), F.col("label1").alias("label"), shared.alias("matches_best"), "overlapping")


def alternates(found: DataFrame, best: DataFrame, sizes: DataFrame, within: int = 1) -> DataFrame:
    """Of each k the highest vascular cluster that peaks 1 to within samples after the best, if it is higher and of fewer blobs: a suggestion, never a change.

    sizes (k, label, blob, n) are lattice.blob_sizes of the clusters.
    """
    count = sizes.groupBy("k", "label").agg(F.count("*").alias("blobs"))
    b = best.join(count, ["k", "label"]).select("k", F.col("blobs").alias("best_blobs"), F.col("peak_index").alias("best_index"), F.col("peak_value").alias("best_value"))
    near = found.where("vascular").join(b, "k").where((F.col("peak_index") - F.col("best_index")).between(1, within) & (F.col("peak_value") > F.col("best_value")))
    order = Window.partitionBy("k").orderBy(F.desc("peak_value"), "label")
    top = near.withColumn("place", F.row_number().over(order)).where("place = 1").join(count, ["k", "label"])
    return top.where("blobs < best_blobs").select("k", "label", "peak_index", "peak_value")


def runners_up(found: DataFrame, best: DataFrame, offsets: tuple[int, ...] | None = (1, 2)) -> DataFrame:
    """(k, offset, place, label, peak_value): the vascular clusters that peak so many samples after the best of their k, the highest
    first. offsets None takes all that peak later."""
    b = best.select("k", F.col("peak_index").alias("best_index"))
    later = found.where("vascular").join(b, "k").withColumn("offset", F.col("peak_index") - F.col("best_index"))
    later = later.where("offset > 0") if offsets is None else later.where(F.col("offset").isin(*offsets))
    order = Window.partitionBy("k", "offset").orderBy(F.desc("peak_value"), "label")
    return later.select("k", "offset", F.row_number().over(order).alias("place"), "label", "peak_value")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new added or put in place of those with the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def kmeans_step(points: DataFrame, centers: list[list[float]]) -> DataFrame:
    """(label, center, n): one step of Lloyd's algorithm from k centres, which are literals of the plan.

    A voxel finds its centre in its own row, so the means are the only shuffle, and of partial sums.
    """
    dims = len(centers[0])
    table = F.array(*[F.struct(F.lit(i + 1).alias("label"), F.array(*map(F.lit, c)).alias("center")) for i, c in enumerate(centers)])
    away = lambda c: F.round(F.aggregate(F.zip_with("point", c["center"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x), 9)
    nearest = F.array_min(F.transform(table, lambda c: F.struct(away(c).alias("away"), c["label"].alias("label"))))["label"]
    means = F.array(*[F.avg(F.col("point")[i]) for i in range(dims)])
    return points.select(nearest.alias("label"), "point").groupBy("label").agg(means.alias("center"), F.count("*").alias("n"))


def long_table(found: DataFrame, centroid_curves: DataFrame, best: DataFrame) -> DataFrame:
    """Curves with their clusters' traits and whether they are the best of their k."""
    flags = best.select("k", "label", F.lit(True).alias("best_in_k"))
    return centroid_curves.drop("voxel_count").join(found, ["k", "label"]).join(flags, ["k", "label"], "left").withColumn("best_in_k", F.coalesce("best_in_k", F.lit(False)))




def table(found: DataFrame, curves_in_time: DataFrame, sizes: DataFrame, best: DataFrame, overall: DataFrame, added: dict[str, object] | None = None, share: float = 0.95) -> DataFrame:
    """A row a cluster with all that is known of it: the added values as first columns, then k, label and name (l-label_k-k), peak_index,
    peak_value, auc, voxel_count, voxels_in_img, blob_count, voxels_per_blob, sparsity (how many blobs, the largest first, make
    up share of its voxels), best_in_k, best_overall, the lines' whole_slope, whole_intercept, wo_first_slope and
    wo_first_intercept, and whatever other columns found has.

    found: traits (k, label, peak_index, peak_value, voxel_count, ...); curves_in_time: (k, label, frame, t, activity); sizes:
    lattice.blob_sizes; best, overall: the chosen (k, label). Clusters without blobs have 0 of them.
    """
    keys = ["k", "label"]
    areas, slopes = curves.auc(curves_in_time, keys), curves.lines(curves_in_time, keys)
    blobs = lattice.sparsity(sizes, keys, share).groupBy(*keys).agg(F.count("*").alias("blob_count"), F.avg("n").alias("voxels_per_blob"), F.count_if("kept").alias("sparsity"))
    flag = lambda chosen, name: chosen.select(*keys, F.lit(True).alias(name))
    rows = found.withColumn("voxels_in_img", F.sum("voxel_count").over(Window.partitionBy("k")))
    for more in (areas, slopes, blobs, flag(best, "best_in_k"), flag(overall, "best_overall")):
        rows = rows.join(more, keys, "left")
    rows = rows.withColumn("name", F.format_string("l-%d_k-%d", "label", "k"))
    rows = rows.fillna(False, ["best_in_k", "best_overall"]).fillna(0, ["blob_count", "voxels_per_blob", "sparsity"])
    first = [*keys, "name", "peak_index", "peak_value", "auc", "voxel_count", "voxels_in_img", "blob_count", "voxels_per_blob", "sparsity", "best_in_k", "best_overall", *slopes.columns[2:]]
    rest = [c for c in found.columns if c not in first]
    return rows.select(*[F.lit(v).alias(n) for n, v in (added or {}).items()], *first, *rest)


#: What a curve that lacks a column has there, in a table of curves of all kinds.
ABSENT = {"k": 0, "label": 0, "source": "n/a", "name": "n/a", "best_overall": False, "best_in_k": False}


def plottable(*tables: DataFrame, features: tuple[str, ...] = ()) -> DataFrame:
    """(t, activity, k, label, source, name, best_overall, best_in_k, features...) of curves of all kinds, one below the other.

    tables have t and activity and any of the other columns; what one lacks, or has as null, is as ABSENT says, and null for
    features. Further columns are left out.
    """

    def one(rows: DataFrame) -> DataFrame:
        have = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in rows.columns else F.lit(default)
        own = [F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in features]
        return rows.select("t", "activity", *[have(c, v).alias(c) for c, v in ABSENT.items()], *own)

    found = one(tables[0])
    for rows in tables[1:]:
        found = found.unionByName(one(rows))
    return found
