"""Rate constants, their densities and closed-form models, as columns. The fits are in tracer.py."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.functions.curves import interpolate, pchip_at


def ki(k1: Column, k2: Column, k3: Column) -> Column:
    return k1 * k3 / (k2 + k3)


def model(k1: Column, k2: Column, k3: Column, name: Column) -> Column:
    """A two-tissue model as one value: (name, k1, k2, k3, ki, text), text being its equation with the numbers put in."""
    k = ki(k1, k2, k3)
    text = F.format_string("'%s': ki = k1 * (k3 / (k2 + k3)) = %.2f * (%.2f / (%.2f + %.2f)) = %.2f", name, k1, k3, k2, k3, k)
    return F.struct(name.alias("name"), k1.alias("k1"), k2.alias("k2"), k3.alias("k3"), k.alias("ki"), text.alias("text"))


def validity(k1: Column, k2: Column, k3: Column, least: float = 1e-4) -> Column:
    """0, or the failure's code: 41 if a constant is near 0, 42 if one is near 1."""
    near = lambda f: F.greatest(*[F.when(f(c) < least, 1).otherwise(0) for c in (k1, k2, k3)]) == 1
    return F.when(near(lambda c: c), 41).when(near(lambda c: F.abs(1 - c)), 42).otherwise(0)


def vascular_correction(activity: Column, fit: Column, percent: float, twice: bool = False) -> Column:
    """(activity - p * fit) / (1 - p); the second pass of bootstrap curves corrects what is corrected already."""
    p = F.lit(percent / 100)
    once = (activity - p * fit) / (1 - p)
    return (once - p * fit) / (1 - p) if twice else once


#: Widths of a kernel beyond which a value doesn't count for the density.
REACH = 9.0


def kde_fwhm(values: DataFrame, keys: list[str], value: str, points: int = 1000) -> DataFrame:
    """Of each group: the peak of its Gaussian kernel density (Scott's width) on an even grid, and the outermost points over half of it.

    Equal values are counted first, so that the grid meets distinct values only, and each of them only the points within REACH widths
    of it: what it adds beyond is under 3e-18 of what it adds at its own place.
    """
    counted = values.groupBy(*keys, value).agg(F.count("*").alias("w"))
    v, w = F.col(value), F.col("w")
    stats = counted.groupBy(*keys).agg(F.sum("w").alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.sum(w * v).alias("s1"), F.sum(w * v * v).alias("s2"))
    sd = F.sqrt((F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")) / (F.col("n") - 1))
    stats = stats.select(*keys, "n", "low", "high", (sd * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("h"))
    grid = F.col("low") + F.col("i") * (F.col("high") - F.col("low")) / (points - 1)
    step, far = F.nullif((F.col("high") - F.col("low")) / (points - 1), F.lit(0.0)), REACH * F.col("h")
    first = F.greatest(F.coalesce(F.ceil((v - far - F.col("low")) / step), F.lit(0)), F.lit(0))
    last = F.least(F.coalesce(F.floor((v + far - F.col("low")) / step), F.lit(points - 1)), F.lit(points - 1))
    # The row of a group has five numbers; groups are scans times parameters, joined as Spark sees fit.
    near = counted.join(stats, keys).withColumn("i", F.explode(F.sequence(F.least(first, last), F.greatest(first, last)))).withColumn("x", grid)
    u = (F.col("x") - v) / F.col("h")
    density = near.groupBy(*keys, "i").agg(F.first("x").alias("x"), (F.sum(w * F.exp(-u * u / 2)) / (F.first("n") * F.first("h") * F.lit(float(np.sqrt(2 * np.pi))))).alias("density"))
    top = F.max("density").over(Window.partitionBy(*keys))
    return density.withColumn("top", top).groupBy(*keys).agg(F.min(F.when(F.col("density") > F.col("top") / 2, F.col("x"))).alias("left"), F.min_by("x", F.struct(-F.col("density"), F.col("x"))).alias("peak"), F.max(F.when(F.col("density") > F.col("top") / 2, F.col("x"))).alias("right"), F.max("top").alias("max_density"))


def impulse_response(k1: Column, k2: Column, k3: Column, t: Column, k4: Column | None = None) -> Column:
    """Of two tissue compartments; without k4 nothing comes back from the second."""
    if k4 is None:
        s = k2 + k3
        return k1 / s * (k3 + k2 * F.exp(-s * t))
    s = k2 + k3 + k4
    root = F.sqrt(s * s - 4 * k2 * k4)
    slow, fast = (s - root) / 2, (s + root) / 2
    return k1 / root * ((k3 + k4 - slow) * F.exp(-slow * t) + (fast - k3 - k4) * F.exp(-fast * t))


def zeta(ks: tuple[float, float], kt: tuple[float, float], t: Column) -> Column:
    """The kernel that turns a source region's curve into a target's, (k2, k3) each, in closed form."""
    k2s, k3s = ks
    k2t, k3t = kt
    r = k2t + k3t
    if abs(r - k3s) < 1e-12:
        raise ValueError("singular: k2t + k3t equals k3s")
    alpha, beta = k2s - k2t, k3t * (k2s + k3s) - k3s * r
    nu, eps = -min(k3s, r), -max(k3s, r)
    m = (beta + alpha * eps) / (eps - nu)
    return F.lit(alpha - m) * F.exp(F.lit(nu) * t) + F.lit(m) * F.exp(F.lit(eps) * t)


def source_to_target_cost(curves: DataFrame, rates: DataFrame, peaks: DataFrame, step: float, weight: str = "weight") -> DataFrame:
    """(source, cost): how far all other regions' curves are from those that each source's curve and the rates predict.

    curves: (region, frame, activity, weight) at even times step apart; rates: (region, k1, k2, k3); peaks: (region, ki).
    The cost is the weighted sum of squares over targets and frames, and the sum over regions of the distance of Ki from
    its peak. rates and peaks are tables of regions.
    """
    s = rates.select(F.col("region").alias("source"), *[F.col(c).alias(f"{c}s") for c in ("k1", "k2", "k3")])
    t = rates.select(F.col("region").alias("target"), *[F.col(c).alias(f"{c}t") for c in ("k1", "k2", "k3")])
    c = F.col
    r = c("k2t") + c("k3t")
    pairs = s.join(t, c("source") != c("target"))
    pairs = pairs.withColumn("nu", -F.least(c("k3s"), r)).withColumn("eps", -F.greatest(c("k3s"), r)).withColumn("alpha", c("k2s") - c("k2t"))
    beta = c("k3t") * (c("k2s") + c("k3s")) - c("k3s") * r
    pairs = pairs.withColumn("m", (beta + c("alpha") * c("eps")) / (c("eps") - c("nu"))).withColumn("scale", c("k1t") / c("k1s"))
    pairs = F.broadcast(pairs.select("source", "target", "nu", "eps", "alpha", "m", "scale"))
    at = curves.select(c("region").alias("source"), c("frame").alias("from"), c("activity").alias("own"))
    own = curves.select(c("region").alias("target"), "frame", "activity", weight)
    # A curve is some tens of frames, so pairs of frames of one region pair are few.
    rows = own.join(pairs, "target").join(at, "source").where(c("from") <= c("frame"))
    lag = (c("frame") - c("from")) * F.lit(float(step))
    zeta = (c("alpha") - c("m")) * F.exp(c("nu") * lag) + c("m") * F.exp(c("eps") * lag)
    fit = F.sum(c("scale") * c("own") * (F.lit(float(step)) * zeta + F.when(c("from") == c("frame"), 1.0).otherwise(0.0)))
    off = rows.groupBy("source", "target", "frame").agg(fit.alias("fit"), F.first("activity").alias("activity"), F.first(weight).alias("w"))
    cost = off.groupBy("source").agg(F.sum(c("w") * F.pow(c("activity") - c("fit"), 2)).alias("cost"))
    penalty = rates.join(peaks, "region").agg(F.sum(F.abs(ki(c("k1"), c("k2"), c("k3")) - c("ki"))).alias("penalty"))
    return cost.crossJoin(F.broadcast(penalty)).select("source", (c("cost") + c("penalty")).alias("cost"))


def full_curve(curves: DataFrame, fits: DataFrame, keys: list[str], step: float = 0.1, with_peak: bool = True) -> DataFrame:
    """(keys, i, t, activity): each curve (keys, t, activity) on an even grid of step from 0 to its last time.

    Up to the peak the samples are interpolated linearly, on the first two samples' line before the first; from the peak on
    the curve is the fit's. fits: (keys, terms: array of (c, rate)). Without with_peak the peak is no knot: before it the
    curve is flat beyond the samples at both ends, negative values are 0, and all are 0 if the first sample is the peak.
    """
    top = F.min_by(F.struct(F.col("t").alias("t"), F.col("activity").alias("a")), F.struct(-F.col("activity"), F.col("t")))
    ends = curves.groupBy(*keys).agg(top.alias("top"), F.max("t").alias("last"))
    n = F.floor(F.round(F.col("last") / F.lit(step), 6)).cast("int")
    grid = ends.withColumn("i", F.explode(F.sequence(F.lit(0), n))).select(*keys, "i", F.round(F.col("i") * F.lit(step), 6).alias("t"), F.col("top.t").alias("peak"))
    before = curves.join(ends.select(*keys, F.col("top.t").alias("peak")), keys).where(F.col("t") <= F.col("peak") if with_peak else F.col("t") < F.col("peak")).select(*keys, "t", "activity")
    early = interpolate(before, grid.where("t < peak").select(*keys, "t"), keys, extrapolate=with_peak)
    if not with_peak:
        early = early.withColumn("activity", F.greatest(F.coalesce("activity", F.lit(0.0)), F.lit(0.0)))
    decay = F.aggregate("terms", F.lit(0.0), lambda s, x: s + x["c"] * F.exp(-x["rate"] * F.col("t")))
    late = grid.where("t >= peak").join(fits, keys).withColumn("activity", decay)
    early = grid.where("t < peak").join(early, [*keys, "t"])
    return early.select(*keys, "i", "t", "activity").unionByName(late.select(*keys, "i", "t", "activity"))


def resampled(curves: DataFrame, fits: DataFrame, keys: list[str], step: float = 0.1) -> DataFrame:
    """(keys, t, activity): full_curve by its monotone cubics at each curve's own times."""
    return pchip_at(full_curve(curves, fits, keys, step), curves.select(*keys, "t"), keys)


def equation(terms: Column) -> Column:
    """The text of a sum of decays (terms: array of (c, rate)), the largest coefficients first; equal ones stay in order."""
    larger_first = lambda a, b: F.when(a["c"] > b["c"], -1).when(a["c"] < b["c"], 1).otherwise(0)
    text = lambda x: F.format_string("%.2fe^{%.2ft}", x["c"], -x["rate"])
    return F.array_join(F.transform(F.array_sort(terms, larger_first), text), " + ")


def resample_weights(row_key: Column, seed: int, copy: Column | int = 0, most: int = 12) -> Column:
    """How often a draw with replacement of as many rows takes the row: Poisson with mean 1, by a hash of the row's key.

    The same seed, copy and key always give the same number, so that no draw is made on the driver and a lost task gives what it
    gave. Numbers over most, of a chance of 1e-10 at 12, count as most.
    """
    copy = F.lit(copy) if isinstance(copy, int) else copy
    digest = F.md5(F.concat_ws("-", F.lit(seed).cast("string"), copy.cast("string"), row_key.cast("string")))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    below = [sum(math.exp(-1) / math.factorial(i) for i in range(n + 1)) for n in range(most)]
    return sum((F.when(u >= F.lit(b), 1).otherwise(0) for b in below), F.lit(0))


def resampled_density(values: DataFrame, keys: list[str], value: str, weight: str, bins: int = 100) -> DataFrame:
    """(keys, bin from 0, low, high, n): a histogram of weighted values in so many equal bins from each key's least to its greatest.

    Rows of weight 0 and null values don't count. All values equal are one bin of width 0. Bins without a value have no row.
    """
    rows = values.where((F.col(weight) > 0) & F.col(value).isNotNull())
    ends = rows.groupBy(*keys).agg(F.min(value).alias("least"), F.max(value).alias("most"))
    width = (F.col("most") - F.col("least")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("least")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).otherwise(0).cast("int")
    edge = lambda i: F.col("least") + i * width
    # A row a key: scans times parameters, joined as Spark sees fit.
    placed = rows.join(ends, keys).withColumn("bin", at)
    return placed.groupBy(*keys, "bin").agg(F.first(edge(F.col("bin"))).alias("low"), F.first(edge(F.col("bin") + 1)).alias("high"), F.sum(weight).alias("n"))
