"""Fits of tracer curves: multi-start decays, bootstrap sets of rate constants, annealing of the source-to-target cost.

The kernels are seeded numpy; Spark deals one curve, one bootstrap copy or one source region to a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Outcomes of a fit (fixed values). 0 is success.
NAN, INFINITE, ERROR, NO_END, OVERFLOW, SINGULAR, NEGATIVE, REGION, REGION_VALUE, NEAR_ZERO, NEAR_ONE = 2, 3, 4, 11, 12, 14, 15, 21, 31, 41, 42
FAILURES = {
    NAN: "a parameter is not a number", INFINITE: "a parameter is infinite", ERROR: "the weighted error is too large", NO_END: "no convergence within the steps",
    OVERFLOW: "overflow", SINGULAR: "singular equations", NEGATIVE: "the fitted curve has negative values",
    REGION: "a region's constants did not converge", REGION_VALUE: "a region's cost has no value", NEAR_ZERO: "a rate constant is near 0", NEAR_ONE: "a rate constant is near 1",
}
#: The greatest weighted sum of squared errors of a fit that ended well.
MOST_ERROR = 10.0
#: Starting values: coefficients and exponents are drawn from these ranges.
COEFFICIENTS, EXPONENTS = (0.0, 128.0), (-2.0, 10.0)
#: Rounds of the pattern search that ends an annealing.
LOCAL_ROUNDS = 200
#: Cost of parameters for which the model has no value.
NO_VALUE = 999.0


def decays(t: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The sum of p[0] exp(-p[1] t), p[2] exp(-p[3] t), ..."""
    return sum(p[i] * np.exp(np.clip(-p[i + 1] * t, -700, 700)) for i in range(0, len(p), 2))


def decay_slopes(t: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The derivatives of decays() by its parameters (times x parameters)."""
    powers = np.exp(np.clip(-np.outer(t, p[1::2]), -700, 700))
    return np.stack([powers, -p[::2] * t[:, None] * powers], 2).reshape(len(t), -1)


def least_squares(residual: Callable[[np.ndarray], np.ndarray], p: np.ndarray, low: np.ndarray | float = -np.inf, high: np.ndarray | float = np.inf, steps: int = 200, slopes: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, float, int]:
    """(parameters, sum of squares, code): damped Gauss-Newton steps with the Jacobian that slopes gives, else a numeric one, kept within the bounds."""
    damping, r = 1e-2, residual(p)
    cost = float(r @ r)
    if not np.isfinite(cost):
        return p, cost, OVERFLOW
    for _ in range(steps):
        if slopes:
            j = slopes(p)
        else:
            eps = 1e-6 * np.maximum(1e-3, np.abs(p))
            j = np.stack([(residual(p + eps * (np.arange(len(p)) == i)) - r) / eps[i] for i in range(len(p))], 1)
        a, g = j.T @ j, j.T @ r
        if not np.isfinite(a).all():
            return p, cost, OVERFLOW
        while True:
            try:
                new = np.clip(p + np.linalg.solve(a + damping * np.diag(np.diag(a) + 1e-12), -g), low, high)
            except np.linalg.LinAlgError:
                return p, cost, SINGULAR
            rn = residual(new)
            cn = float(rn @ rn)
            if np.isfinite(cn) and cn < cost:
                break
            damping *= 5
            if damping > 1e10:
                return p, cost, 0
        done = cost - cn < 1.5e-8 * cost or cn < 1e-20
        p, r, cost, damping = new, rn, cn, max(damping / 5, 1e-12)
        if done:
            return p, cost, 0
    return p, cost, NO_END


def fit_once(t: np.ndarray, y: np.ndarray, sigma: np.ndarray, terms: int, rng: np.random.Generator) -> tuple[np.ndarray, float, int]:
    """(parameters, weighted error, code) of decays from one random start; errors are weighed by 1 / sqrt(sigma) for the verdict."""
    start = np.stack([rng.uniform(*COEFFICIENTS, terms), rng.uniform(*EXPONENTS, terms)], 1).ravel()
    with np.errstate(all="ignore"):
        p, _, code = least_squares(lambda q: (decays(t, q) - y) / sigma, start, slopes=lambda q: decay_slopes(t, q) / sigma[:, None])
        if code:
            return p, np.nan, code
        if np.isnan(p).any():
            return p, np.nan, NAN
        if np.isinf(p).any():
            return p, np.nan, INFINITE
        error = float((((decays(t, p) - y) ** 2) / np.sqrt(sigma)).sum())
    return p, error, 0 if error <= MOST_ERROR else ERROR


FIT_SCHEMA = "curve_id long, code int, start int, parameters array<double>, error double, n int"


def fit_decays(curves: DataFrame, successes: int = 10, failures: int = 4096, terms: int = 3, seed: int = 42) -> DataFrame:
    """Multi-start fits of each curve (curve_id, t, activity, sigma): a row (code 0) a start that ended well, and a row a failure code with its count n.

    Starts go on until so many successes or failures; each is seeded by its number. Null samples are left out.
    """
    parts = int(curves.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna().sort_values("t")
        t, y, sigma = (pdf[c].to_numpy() for c in ("t", "activity", "sigma"))
        found, failed, start = [], {}, 0
        while len(pdf) and len(found) < successes and sum(failed.values()) < failures:
            p, error, code = fit_once(t, y, sigma, terms, np.random.default_rng(seed + 7 * start))
            if code:
                failed[code] = failed.get(code, 0) + 1
            else:
                found.append((int(pdf["curve_id"].iloc[0]), 0, start, p.tolist(), error, 1))
            start += 1
        lost = [(int(pdf["curve_id"].iloc[0]), code, None, None, None, n) for code, n in sorted(failed.items())]
        return pd.DataFrame(found + lost, columns=["curve_id", "code", "start", "parameters", "error", "n"]).astype({"start": "Int32"})

    return curves.select("curve_id", "t", "activity", "sigma").repartition(parts, "curve_id").groupBy("curve_id").applyInPandas(fit, FIT_SCHEMA)


def best_fits(fits: DataFrame) -> DataFrame:
    """(curve_id, start, error, terms): each curve's fit of the least error; terms (c, rate), the largest coefficient first."""
    best = F.min_by(F.struct("start", "parameters", "error"), F.struct("error", "start"))
    rows = fits.where("code = 0").groupBy("curve_id").agg(best.alias("best")).select("curve_id", "best.*")
    pairs = F.transform(F.expr("sequence(0, cast(size(parameters) / 2 as int) - 1)"), lambda i: F.struct(F.get("parameters", 2 * i).alias("c"), F.get("parameters", 2 * i + 1).alias("rate")))
    return rows.select("curve_id", "start", "error", F.reverse(F.array_sort(pairs)).alias("terms"))


def failure_counts(fits: DataFrame) -> DataFrame:
    """(code, reason, n) over all curves."""
    reason = F.create_map(*[F.lit(x) for pair in FAILURES.items() for x in pair])
    return fits.where("code > 0").groupBy("code").agg(F.sum("n").alias("n")).withColumn("reason", reason[F.col("code")])


def failure_records(sets: DataFrame) -> DataFrame:
    """(code, copy, reason, region, parameters) of bootstrap rows that were made with each_failure."""
    reason = F.create_map(*[F.lit(x) for pair in FAILURES.items() for x in pair])
    return sets.where("code > 0").select("code", "copy", reason[F.col("code")].alias("reason"), "region", "parameters")


def append_failures(records: DataFrame, path: str) -> None:
    """Adds records to the table under path, a folder a code; a code's records are read without the others', and never meet in memory."""
    records.write.mode("append").partitionBy("code").parquet(path)


def failure_summary(records: DataFrame) -> DataFrame:
    """(code, n, copies, place, mean, least, most): how often each failure arose, in how many copies, and of each parameter by place its mean and range."""
    counts = records.groupBy("code").agg(F.count("*").alias("n"), F.count_distinct("copy").alias("copies"))
    at = records.select("code", F.posexplode("parameters").alias("place", "value")).groupBy("code", "place").agg(F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))
    return counts.join(at, "code", "left")


def pchip(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Monotone cubic interpolation with Fritsch-Carlson slopes; beyond the ends the end pieces go on."""
    h, m = np.diff(x), np.diff(y) / np.diff(x)
    d = np.zeros(len(x))
    if len(x) == 2:
        d[:] = m[0]
    else:
        a, b = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
        same = m[:-1] * m[1:] > 0
        d[1:-1][same] = ((a + b)[same]) / (a[same] / m[:-1][same] + b[same] / m[1:][same])
        for end, (h0, h1, m0, m1) in ((0, (h[0], h[1], m[0], m[1])), (-1, (h[-1], h[-2], m[-1], m[-2]))):
            s = ((2 * h0 + h1) * m0 - h0 * m1) / (h0 + h1)
            d[end] = 0.0 if np.sign(s) != np.sign(m0) else 3 * m0 if np.sign(m0) != np.sign(m1) and abs(s) > 3 * abs(m0) else s
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(h) - 1)
    u, w = (at - x[k]) / h[k], h[k]
    return y[k] * (2 * u**3 - 3 * u**2 + 1) + w * d[k] * (u**3 - 2 * u**2 + u) + y[k + 1] * (3 * u**2 - 2 * u**3) + w * d[k + 1] * (u**3 - u**2)


def tissue(grid: np.ndarray, source: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The tissue curve of two compartments (k4 = 0) on an even grid: the source convolved with the impulse response."""
    k1, k2, k3 = k
    total = max(k2 + k3, 1e-9)
    return np.convolve(k1 / total * (k3 + k2 * np.exp(-total * grid)), source)[: len(grid)] * (grid[1] - grid[0])


SET_SCHEMA = "copy int, region string, code int, k1 double, k2 double, k3 double, ki double, n int, parameters array<double>"


def bootstrap(source: DataFrame, regions: DataFrame, n: int = 500, percent: float = 5.0, step: float = 0.5, tries: int = 10, failures: int = 4096, terms: int = 3, seed: int = 998, each_failure: bool = False) -> DataFrame:
    """Rate constants of all regions for n perturbed copies of a source curve.

    source: (t, activity, sd, sigma), one curve; regions: (region, t, activity) at the same times. A copy's samples from the
    peak on are the mean plus a uniform draw within their sd; decays are fitted to them (a fit with a negative value is
    rejected); the copy then corrects each region's curve for its share of blood (percent), and each is fitted for k1, k2 and
    k3 in [0, 1], from up to tries random starts. If a constant of any region is near 0 or 1 the whole set is rejected, and
    new samples are drawn, until a set is good or so many have failed. Copies are rows and groups of their own, seeded by
    their number. A row (code 0) a region of a good set; a row (region null) a failure code of a copy with its count n. With
    each_failure a row (n = 1) each failure instead, with its parameters (the decays', or a region's start) and its region.
    """
    spark = source.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # One row with both curves: a curve has some tens of samples, and regions are few.
    one = source.agg(F.sort_array(F.collect_list(F.struct("t", "activity", "sd", "sigma"))).alias("source"))
    many = regions.groupBy("region").agg(F.sort_array(F.collect_list(F.struct("t", "activity"))).alias("samples")).agg(F.sort_array(F.collect_list(F.struct("region", "samples"))).alias("regions"))
    copies = spark.range(n).select(F.col("id").cast("int").alias("copy")).repartition(max(parts, min(n, 64)), "copy").crossJoin(F.broadcast(one.crossJoin(many)))

    def draw(copy: int, rows: list, tissues: list) -> list[tuple]:
        t, mean, sd, sigma = (np.array([r[c] for r in rows], float) for c in ("t", "activity", "sd", "sigma"))
        names, samples = [r["region"] for r in tissues], [np.array([s["activity"] for s in r["samples"]], float) for r in tissues]
        peak, rng, failed = int(mean.argmax()), np.random.default_rng(seed + copy), {}
        grid = np.arange(0, t[-1] + step / 2, step)
        late = grid >= t[peak]
        # The peak is no knot of the rise; negative values of it are 0.
        early = np.maximum(np.interp(grid[~late], t[:peak], mean[:peak]), 0.0) if peak else np.zeros(int((~late).sum()))
        weights = 1 / np.sqrt(sigma)
        # At knots the interpolation is the curve itself.
        knots = np.rint(t / step).astype(int)
        at_t = (lambda curve: curve[knots]) if np.allclose(grid[knots], t) else (lambda curve: pchip(grid, curve, t))
        each: list[tuple] = []

        def fail(code: int, parameters: np.ndarray, region: str | None = None) -> None:
            failed[code] = failed.get(code, 0) + 1
            if each_failure:
                each.append((copy, region, code, None, None, None, None, 1, [float(v) for v in np.ravel(parameters)]))

        lost = lambda: each or [(copy, None, code, None, None, None, None, times, None) for code, times in sorted(failed.items())]
        while sum(failed.values()) < failures:
            noisy = mean[peak:] + (2 * rng.random(len(mean) - peak) - 1) * sd[peak:]
            p, _, code = fit_once(t[peak:], noisy, sigma[peak:], terms, rng)
            if code:
                fail(code, p)
                continue
            curve = np.concatenate([early, decays(grid[late], p)])
            if (curve[late] < 0).any():
                fail(NEGATIVE, p)
                continue
            blood, found = at_t(curve) * percent / 100, []
            for name, raw in zip(names, samples, strict=True):
                own = (raw - blood) / (1 - percent / 100)
                residual = lambda k, own=own, curve=curve: weights * (own - at_t(tissue(grid, curve, k)))
                for _ in range(tries):
                    start = rng.random(3)
                    k, _, code = least_squares(residual, start, 0.0, 1.0, 60)
                    if not code:
                        break
                    fail(REGION_VALUE if code == OVERFLOW else REGION, start, name)
                found.append(k)
            k = np.array(found)
            if (k < 1e-4).any():
                fail(NEAR_ZERO, k)
            elif (np.abs(1 - k) < 1e-4).any():
                fail(NEAR_ONE, k)
            else:
                good = [(copy, name, 0, *map(float, c), float(c[0] * c[2] / (c[1] + c[2])), 1, None) for name, c in zip(names, k, strict=True)]
                return good + lost()
        return lost()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                yield pd.DataFrame(draw(int(row.copy_), list(row.source), list(row.regions)), columns=["copy", "region", "code", "k1", "k2", "k3", "ki", "n", "parameters"])

    return copies.select(F.col("copy").alias("copy_"), "source", "regions").mapInPandas(run, SET_SCHEMA)


def good_sets(sets: DataFrame) -> DataFrame:
    """The rate constants of good sets, without any that is null or not a number."""
    values = [F.col(c) for c in ("k1", "k2", "k3", "ki")]
    ok = F.col("code") == 0
    for v in values:
        ok = ok & v.isNotNull() & ~F.isnan(v)
    return sets.where(ok).select("copy", "region", "k1", "k2", "k3", "ki")


def long_rates(sets: DataFrame) -> DataFrame:
    """(copy, region, param, value) of good sets."""
    return good_sets(sets).unpivot(["copy", "region"], ["k1", "k2", "k3", "ki"], "param", "value")


def annealed(cost: Callable[[np.ndarray], float], low: np.ndarray, high: np.ndarray, steps: int, heat: float, rng: np.random.Generator, visit: float = 2.62, accept: float = -5.0) -> tuple[np.ndarray, float]:
    """(parameters, cost) by generalised simulated annealing in a box: heavy-tailed visits, first of all parameters, then of each.

    The heat falls as a power of the step; once it is a 50,000th of the first it starts again. The best place found is
    improved by a pattern search of LOCAL_ROUNDS at the end.
    """
    size, width = len(low), high - low
    tail = (visit - 1) / (3 - visit)

    def jumps(shape: tuple[int, ...], t: float) -> np.ndarray:
        x, y = rng.standard_normal(shape), rng.standard_normal(shape)
        return np.clip(t ** (1 / (visit - 1)) * x / np.maximum(np.abs(y), 1e-12) ** tail, -1e8, 1e8)

    x = low + rng.random(size) * width
    now = cost(x)
    best, least, k = x.copy(), now, 0
    for _ in range(steps):
        t = heat * (2 ** (visit - 1) - 1) / ((k + 2) ** (visit - 1) - 1)
        k = 0 if t < heat * 2e-5 else k + 1
        moves, draws = jumps((2 * size, size), t), rng.random(2 * size)
        for i in range(2 * size):
            y = x + moves[i] if i < size else x + moves[i] * (np.arange(size) == i - size)
            y = low + np.mod(y - low, width)
            c = cost(y)
            if c < now or draws[i] <= max(0.0, 1 + (accept - 1) * (c - now) * (k + 1) / t) ** (1 / (1 - accept)) * (c - now < t):
                x, now = y, c
                if c < least:
                    best, least = y.copy(), c
    reach = width * 0.05
    for _ in range(LOCAL_ROUNDS):
        moved = False
        for i in range(size):
            for sign in (1, -1):
                y = best.copy()
                y[i] = np.clip(y[i] + sign * reach[i], low[i], high[i])
                if (c := cost(y)) < least:
                    best, least, moved = y, c, True
        if not moved:
            reach = reach / 2
    return best, least


def anneal(regions: DataFrame, bounds: DataFrame, step: float, steps: int = 5000, heat: float = 5230.0, seed: int = 5) -> DataFrame:
    """For each source region, the rate constants of all regions that least miss the source-to-target model, within bounds.

    regions: (region, t, activity, weight) at even times step apart, else ValueError; bounds: (region, param, low, peak,
    high) for k1, k2, k3 and, for the penalty, ki. One group a source, which sees all regions' curves: a table of regions.
    Rows (source, region, k1, k2, k3, ki, cost).
    """
    parts = int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    curves = regions.groupBy("region").agg(F.sort_array(F.collect_list(F.struct("t", "activity", "weight"))).alias("samples"))
    edges = bounds.groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("param", F.struct("low", "peak", "high")))).alias("bounds"))
    everything = curves.join(edges, "region").agg(F.sort_array(F.collect_list(F.struct("region", "samples", F.map_entries("bounds").alias("bounds")))).alias("regions"))
    # Without bounds, as when no set is good, there is nothing to search.
    sources = everything.where(F.size("regions") > 0).withColumn("place", F.explode(F.sequence(F.lit(0), F.size("regions") - 1))).repartition(parts, "place")

    def one(place: int, rows: list) -> pd.DataFrame:
        names, n = [r["region"] for r in rows], len(rows)
        t, w = (np.array([s[c] for s in rows[0]["samples"]], float) for c in ("t", "weight"))
        if len(t) < 2 or np.ptp(np.diff(t)) > 1e-7 or abs(t[1] - t[0] - step) > 1e-7:
            raise ValueError("the times are not step apart")
        y = np.array([[s["activity"] for s in r["samples"]] for r in rows], float)
        box = [{e["key"]: e["value"] for e in r["bounds"]} for r in rows]
        low, high = (np.array([b[p][side] for p in ("k1", "k2", "k3") for b in box], float) for side in ("low", "high"))
        peaks = np.array([b["ki"]["peak"] for b in box], float)
        lags = np.arange(len(t)) * step
        back = np.subtract.outer(np.arange(len(t)), np.arange(len(t)))
        shifted = np.where(back >= 0, y[place][np.maximum(back, 0)], 0.0)  # times a kernel it is their convolution
        others = np.arange(n) != place

        def cost(x: np.ndarray) -> float:
            k1, k2, k3 = x[:n], x[n : 2 * n], x[2 * n :]
            s, r = k2[place] + k3[place], (k2 + k3)[others]
            with np.errstate(all="ignore"):
                nu, eps, alpha = -np.minimum(k3[place], r), -np.maximum(k3[place], r), k2[place] - k2[others]
                m = (k3[others] * s - k3[place] * r + alpha * eps) / (eps - nu)
                zeta = (alpha - m) * np.exp(np.outer(lags, nu)) + m * np.exp(np.outer(lags, eps))
                fits = k1[others] / k1[place] * (step * (shifted @ zeta) + y[place][:, None])
                off = float((w[:, None] * (y[others].T - fits) ** 2).sum() + np.abs(k1 * k3 / (k2 + k3) - peaks).sum())
            return off if np.isfinite(off) else NO_VALUE

        x, least = annealed(cost, low, np.maximum(high, low + 1e-9), steps, heat, np.random.default_rng(seed + place))
        k1, k2, k3 = x[:n], x[n : 2 * n], x[2 * n :]
        return pd.DataFrame({"source": names[place], "region": names, "k1": k1, "k2": k2, "k3": k3, "ki": k1 * k3 / (k2 + k3), "cost": least})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                yield one(int(row.place), list(row.regions))

    return sources.mapInPandas(run, "source string, region string, k1 double, k2 double, k3 double, ki double, cost double")
