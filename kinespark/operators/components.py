"""k-means sweeps in shared passes, and principal and independent components of voxel curves through their Gram matrix."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinespark.functions.quantiles import quantiles
from kinespark.operators import lattice


@dataclass
class Model:
    """A clustering into k: centers (k x dims), and cost, the sum of squared distances to the nearest of them."""

    k: int
    seed: int
    centers: np.ndarray
    cost: float = float("inf")
    done: bool = False


def _batches(batches: Iterator[pa.RecordBatch], at: int, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        yield batch, batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)


def _squares(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((points * points).sum(1)[:, None] - 2 * points @ centers.T + (centers * centers).sum(1), 0.0)


def _starts(points: DataFrame, dims: int, ks: Sequence[int], seeds: Sequence[int], rounds: int) -> list[Model]:
    """First centres of all models: k-means|| for each seed, all seeds in one scan a round, then weighted k-means++ on the few candidates.

    A round takes 2 * max(ks) more points, by weighted sampling without replacement: those with the least of -log(u) / d^2, u
    being a hash of the voxel, the seed and the round, and d the distance to the candidates so far.
    """
    most = 2 * max(ks)
    pools = {s: np.zeros((0, dims)) for s in seeds}
    u = lambda s, r: (F.pmod(F.xxhash64("vox_id", F.lit(s), F.lit(r)), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    for r in range(rounds + 1):
        take = 1 if r == 0 else most

        def sample(batches: Iterator[pa.RecordBatch], pools=pools, take=take) -> Iterator[pa.RecordBatch]:
            for batch, x in _batches(batches, 0, dims):
                draws = batch.column(1).flatten().to_numpy().reshape(len(x), -1)
                for i, s in enumerate(seeds):
                    weight = _squares(x, pools[s]).min(1) if len(pools[s]) else np.ones(len(x))
                    key = np.where(weight > 0, -np.log(draws[:, i]) / np.where(weight > 0, weight, 1), np.inf)
                    best = np.argsort(key, kind="stable")[:take]
                    best = best[np.isfinite(key[best])]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), s), pa.int64()), pa.array(key[best]), batch.column(0).take(pa.array(best))], ["seed", "key", "point"])

        drawn = points.select("point", F.array(*[u(s, r) for s in seeds]).alias("u")).mapInArrow(sample, "seed long, key double, point array<double>")
        top = Window.partitionBy("seed").orderBy("key", "point")  # of all, a batch gives so many rows at most, and Spark limits them before it shuffles
        for row in drawn.withColumn("place", F.row_number().over(top)).where(F.col("place") <= take).orderBy("seed", "place").collect():
            pools[row["seed"]] = np.vstack([pools[row["seed"]], row["point"]])
    pools = {s: np.unique(c, axis=0) for s, c in pools.items()}
    weights = _sums(points, dims, list(pools.values()))
    out = []
    for at, (s, pool) in enumerate(pools.items()):
        n = np.array([weights.get((at, i), (None, 0, 0))[1] for i in range(len(pool))], float)
        for k in ks:
            rng, chosen = np.random.default_rng([s, k]), []
            for _ in range(min(k, len(pool))):
                d = n * _squares(pool, pool[chosen]).min(1) if chosen else n
                chosen.append(int(rng.choice(len(pool), p=d / d.sum())) if d.sum() > 0 else next(i for i in range(len(pool)) if i not in chosen))
            out.append(Model(k, s, pool[chosen]))
    return out


def _sums(points: DataFrame, dims: int, models: list[np.ndarray]) -> dict[tuple[int, int], tuple[np.ndarray, int, float]]:
    """By model (its centres) and centre: the sum of the points nearest to it, their number, and their squared distances; all models in one scan."""
    flat = np.vstack(models)
    ends = np.cumsum([0, *map(len, models)])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, cost = np.zeros((len(flat), dims)), np.zeros(len(flat), np.int64), np.zeros(len(flat))
        for _, x in _batches(batches, 0, dims):
            for at in range(0, len(x), 4096):
                part = x[at : at + 4096]
                d = _squares(part, flat)
                for a, b in zip(ends[:-1], ends[1:]):
                    own = d[:, a:b].argmin(1)
                    hot = np.zeros((b - a, len(part)))
                    hot[own, np.arange(len(part))] = 1
                    total[a:b] += hot @ part
                    count[a:b] += np.bincount(own, minlength=b - a)
                    cost[a:b] += np.bincount(own, d[np.arange(len(part)), a + own], b - a)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used].tolist(), pa.list_(pa.float64())), pa.array(count[used]), pa.array(cost[used])], ["at", "total", "n", "cost"])

    found = points.select("point").mapInArrow(nearest, "at int, total array<double>, n long, cost double")
    found = found.groupBy("at").agg(*[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(dims)], F.sum("n").alias("n"), F.sum("cost").alias("cost"))
    model_of = np.searchsorted(ends, np.arange(len(flat)), "right") - 1
    out = {}
    for r in found.collect():  # a row a centre of all models
        model = int(model_of[r["at"]])
        out[model, r["at"] - int(ends[model])] = (np.array([r[f"t{i}"] for i in range(dims)]), r["n"], r["cost"])
    return out


def fit_sweep(points: DataFrame, ks: Sequence[int], seeds: Sequence[int] = (42, 43, 44), rounds: int = 50, tolerance: float = 1e-4) -> list[Model]:
    """Lloyd's algorithm for all ks and seeds at once: each round is one scan of the points, whatever the number of models.

    A model is done once no centre moves by more than tolerance. A centre without points stays. The centres of all models go
    to the driver and, as closures, to tasks: the sum of ks times seeds times dims numbers. Fewer distinct points than k give
    as many centres. Rows without a point are left out; without any there is no model.
    """
    points = points.where("point IS NOT NULL")
    first = points.select(F.size("point").alias("n")).first()
    if first is None:
        return []
    dims = first["n"]
    models = _starts(points, dims, ks, seeds, 4)
    for at in range(rounds + 1):
        if not (open_ := [m for m in models if not m.done]):
            break
        sums = _sums(points, dims, [m.centers for m in open_])
        for i, m in enumerate(open_):
            own = [sums.get((i, j)) for j in range(len(m.centers))]
            new = np.array([s[0] / s[1] if s else c for s, c in zip(own, m.centers, strict=True)])
            m.cost = sum(s[2] for s in own if s)
            m.done = at == rounds or np.sqrt(((new - m.centers) ** 2).sum(1)).max() <= tolerance
            if not m.done:  # else cost is that of the centres as they are
                m.centers = new
    return models


def kmeans_sweep(points: DataFrame, ks: Sequence[int], seeds: Sequence[int] = (42, 43, 44), rounds: int = 50) -> DataFrame:
    """(k, vox_id, label from 1): for each k the model of lowest cost over the seeds. points: (vox_id, point: array<double>)."""
    models = fit_sweep(points, ks, seeds, rounds)
    best = [min((m for m in models if m.k == k), key=lambda m: (m.cost, m.seed)) for k in ks if any(m.k == k for m in models)]
    kind = points.schema["vox_id"].dataType.simpleString()
    dims = best[0].centers.shape[1] if best else 1

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _batches(batches, 1, dims):
            for m in best:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), m.k), pa.int32()), batch.column(0), pa.array(_squares(x, m.centers).argmin(1) + 1, pa.int32())], ["k", "vox_id", "label"])

    return points.where("point IS NOT NULL").select("vox_id", "point").mapInArrow(assign, f"k int, vox_id {kind}, label int")


def gram(points: DataFrame, dims: int) -> np.ndarray:
    """The frames x frames matrix of products of the voxels' centred curves: one number a pair of frames from each task, which Spark adds up."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            curves = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            centred = curves - curves.mean(1, keepdims=True)
            total += centred.T @ centred
        i, j = np.triu_indices(dims)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "g"])

    sums = points.select("point").where("point IS NOT NULL").mapInArrow(products, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))
    out = np.zeros((dims, dims))
    for i, j, g in sums.collect():  # dims squared / 2 rows
        out[i, j] = out[j, i] = g
    return out


def principal(points: DataFrame, dims: int, n: int = 6) -> DataFrame:
    """(vox_id, component from 1, score): voxels' scores on the n leading components; each component's largest loading is positive."""
    values, vectors = np.linalg.eigh(gram(points, dims))
    top = vectors[:, np.argsort(-values)[:n]]
    top *= np.where(np.abs(top).max(0) == top.max(0), 1, -1)
    return _scores(points, top)


def independent(points: DataFrame, dims: int, n: int = 6, rounds: int = 200, seed: int = 1) -> DataFrame:
    """(vox_id, component, score) by FastICA over frames: the n leading components' time courses, rotated to independence."""
    values, vectors = np.linalg.eigh(gram(points, dims))
    white = vectors[:, np.argsort(-values)[:n]] * np.sqrt(dims)
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))[0]
    for _ in range(rounds):
        s = np.tanh(white @ w.T)
        new = s.T @ white / dims - np.diag((1 - s**2).mean(0)) @ w
        u, _, v = np.linalg.svd(new)
        new = u @ v
        done = np.abs(np.abs((new * w).sum(1)) - 1).max() < 1e-9
        w = new
        if done:
            break
    return _scores(points, white @ w.T / dims)


def _scores(points: DataFrame, axes: np.ndarray) -> DataFrame:
    columns = F.array(*[F.array(*[F.lit(float(x)) for x in axis]) for axis in axes.T])
    dots = F.transform(columns, lambda axis: F.aggregate(F.zip_with("point", axis, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x))
    return points.select("vox_id", F.posexplode(dots).alias("component", "score")).withColumn("component", F.col("component") + 1)


def decompositions(points: DataFrame, dims: int, few: int = 6) -> DataFrame:
    """(algorithm, components, vox_id, component, score) of the three decompositions: few principal ones, few independent ones, and all independent ones."""
    named = lambda name, n, scores: scores.select(F.lit(name).alias("algorithm"), F.lit(n).alias("components"), "vox_id", "component", "score")
    found = named("pca", few, principal(points, dims, few))
    return found.unionByName(named("ica", few, independent(points, dims, few))).unionByName(named("ica", dims - 1, independent(points, dims, dims - 1)))


def containment(scores: DataFrame, cells: DataFrame, keys: list[str], share: float = 0.95) -> DataFrame:
    """(keys, component, n, ratio): of each component the voxels with a score over its percentile, and how many of them stand in a ball about their centre.

    scores: (keys, vox_id, component, score); cells: (vox_id, x, y, z). The ball is lattice.sphere_ratio's.
    """
    by = [*keys, "component"]
    edges = quantiles(scores, by, "score", share).withColumnRenamed("score", "edge")
    masks = scores.join(edges, by).where("score > edge").select(*by, "vox_id").join(cells, "vox_id")
    return masks.groupBy(*by).agg(F.count("*").alias("n")).join(lattice.sphere_ratio(masks, by), by)


def brain_component(found: DataFrame, keys: list[str], least: float = 0.9) -> DataFrame:
    """(keys, component, n, ratio): of each decomposition the first component whose ratio is over least; no row if none is."""
    return found.where(F.col("ratio") > least).groupBy(*keys).agg(F.min_by(F.struct("component", "n", "ratio"), "component").alias("first")).select(*keys, "first.*")


def component_stats(scores: DataFrame) -> DataFrame:
    """(component, n, mean, sd, low, high) of the voxels' scores; with algorithm and components, where scores have them, by these, too."""
    by = [c for c in ("algorithm", "components") if c in scores.columns]
    return scores.groupBy(*by, "component").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"), F.min("score").alias("low"), F.max("score").alias("high"))
