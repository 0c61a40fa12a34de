"""Two-step clustering as one stage: the sweep over all voxels, the best cluster, and a second clustering within it.

Each part is a table under the run's folder, named by what it is made from (its configuration and that of the parts before
it) and finished when its write is. A run that was stopped goes on at the first part that is missing; one with other
parameters shares the parts that don't depend on them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass
from hashlib import sha256
from json import dumps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespark.operators import clusters, components, lattice, stages
from kinespark.sources import tables


@dataclass(frozen=True)
class Plan:
    """Parameters of a run. source names the input; reduce is the share of the best cluster's voxels, largest blobs first, that stay (0: all)."""

    source: str
    first_ks: tuple[int, ...] = tuple(range(6, 40, 4))
    second_ks: tuple[int, ...] = (4,)
    seeds: tuple[int, ...] = (42, 43, 44)
    rounds: int = 50
    zoom: float = 1.0
    origin: float = 0.0
    keep_confetti_first: bool = False
    keep_confetti_second: bool = True
    reduce: float = 0.0
    peak_limit: float = 10.0


@dataclass
class Steps:
    """The tables of one step: labels (k, vox_id, label), curves, features of all clusters, the best of each k, and the best of all."""

    labels: DataFrame
    curves: DataFrame
    features: DataFrame
    best: DataFrame
    overall: DataFrame


class Run:
    """A run's folder of tables: part() makes what is missing and reads what is there."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.made = spark, path, []

    def part(self, name: str, config: object, make: Callable[[], DataFrame]) -> DataFrame:
        key = sha256(dumps([name, config], sort_keys=True, default=str).encode()).hexdigest()[:20]

        def noted() -> DataFrame:
            self.made.append(name)
            return make()

        return tables.cached(self.spark, f"{self.path}/{name}-{key}", noted)


def long_voxels(points: DataFrame) -> DataFrame:
    """(vox_id, frame from 1, activity)"""
    return points.select("vox_id", F.posexplode("point").alias("at", "activity")).select("vox_id", (F.col("at") + 1).cast("long").alias("frame"), "activity")


def zero_filled(points: DataFrame, mask: DataFrame) -> DataFrame:
    """points (vox_id, point); those outside mask (vox_id) have zeros."""
    inside = mask.select("vox_id").distinct().withColumn("inside", F.lit(True))
    zeros = F.transform("point", lambda x: F.lit(0.0))
    return points.join(inside, "vox_id", "left").select("vox_id", F.when(F.col("inside"), F.col("point")).otherwise(zeros).alias("point"))


def _step(run: Run, name: str, plan: Plan, config: list, points: DataFrame, image: DataFrame, cells: DataFrame, ks: Sequence[int], keep_confetti: bool, peak_time: Callable[[Column], Column]) -> Steps:
    """One clustering of points: the sweep, its curves and features, and the choice of the best. image has the points before any were set to zero."""
    config = [*config, list(ks), list(plan.seeds), plan.rounds]
    labels = run.part(f"{name}-labels", config, lambda: components.kmeans_sweep(points, ks, plan.seeds, plan.rounds))
    curves = run.part(f"{name}-curves", config, lambda: clusters.centroids(long_voxels(points), labels))
    config = [*config, plan.zoom, plan.origin]

    def described() -> DataFrame:
        mass = image.select("vox_id", (F.aggregate("point", F.lit(0.0), lambda s, x: s + x) / F.size("point")).alias("mass"))
        center = lattice.center_of_mass(cells.join(mass, "vox_id"), [], "mass")
        return stages.features(curves, labels.join(cells, "vox_id"), center, plan.zoom, plan.origin)

    found = run.part(f"{name}-features", config, described)
    config = [*config, keep_confetti, plan.peak_limit]
    best = run.part(f"{name}-best", config, lambda: clusters.best_in_k(found.select(*_TRAITS), found, keep_confetti))
    overall = run.part(f"{name}-overall", config, lambda: clusters.best_overall(best, peak_time(F.col("peak_index")), plan.peak_limit))
    return Steps(labels, curves, found, best, overall)


_TRAITS = ["k", "label", "peak_index", "peak_value", "voxel_count", "noise", "irreversible", "background", "vascular"]


def first_mask(run: Run, plan: Plan, first: Steps, cells: DataFrame) -> DataFrame:
    """(vox_id) of the best cluster of the first step, without its small blobs if the plan says so."""
    own = first.labels.join(F.broadcast(first.overall.select("k", "label")), ["k", "label"], "left_semi").select("k", "label", "vox_id")  # one cluster

    def made() -> DataFrame:
        if not plan.reduce:
            return own.select("vox_id")
        keys = ["k", "label"]
        blobs = lattice.blobs(own.join(cells, "vox_id"), keys)
        kept = lattice.sparsity(lattice.blob_sizes(blobs, keys), keys, plan.reduce).where("kept")
        return blobs.join(kept.select(*keys, "blob"), [*keys, "blob"], "left_semi").select("vox_id")

    return run.part("first-mask", asdict(plan) | {"second_ks": None, "keep_confetti_second": None}, made)


def two_step(points: DataFrame, cells: DataFrame, plan: Plan, path: str, peak_time: Callable[[Column], Column]) -> tuple[Run, Steps, DataFrame, Steps, DataFrame]:
    """The run, its first step, the mask between, its second step, and the second step's curves (k, label, frame, voxel_count, activity, sd, best).

    points: (vox_id, point: array<double>); cells: (vox_id, x, y, z); peak_time gives a peak's time from its index. The second
    step clusters all voxels again, with zeros outside the best cluster of the first; its curves are those of the voxels inside.
    Without a vascular cluster in the first step the mask is empty, and there are no curves.
    """
    run = Run(points.sparkSession, path)
    first = _step(run, "first", plan, [plan.source], points, points, cells, plan.first_ks, plan.keep_confetti_first, peak_time)
    mask = first_mask(run, plan, first, cells)
    config = [asdict(plan) | {"second_ks": None, "keep_confetti_second": None}]
    second = _step(run, "second", plan, config, zero_filled(points, mask), points, cells, plan.second_ks, plan.keep_confetti_second, peak_time)

    def curves() -> DataFrame:
        inside = second.labels.join(mask, "vox_id", "left_semi")
        rows = long_voxels(points).join(inside, "vox_id").groupBy("k", "label", "frame").agg(F.count("*").alias("voxel_count"), F.avg("activity").alias("activity"), F.stddev_pop("activity").alias("sd"))
        return rows.join(second.overall.select("k", "label", F.lit(True).alias("best")), ["k", "label"], "left").withColumn("best", F.coalesce("best", F.lit(False)))

    return run, first, mask, second, run.part("second-step-curves", asdict(plan), curves)
