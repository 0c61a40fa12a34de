"""From a vessel's curve and the regions' to tables of rate constants, as one stage of committed tables (two_step.Run).

The vessel's curve is fitted from its peak on, put together with its rise and brought back to its own times; the regions are
corrected for their share of blood; perturbed copies give sets of rate constants, their densities the bounds, and within
these the source-to-target cost is annealed for each source region. The final table is the mean over sources.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinespark.functions import curves
from kinespark.operators import kinetics, tracer
from kinespark.operators.two_step import Run


@dataclass(frozen=True)
class RatePlan:
    """Parameters of a run. source names the input; step is the spacing of even times; percent is the share of blood in tissue; a copy ends after so many failures."""

    source: str
    step: float = 0.5
    percent: float = 5.0
    copies: int = 500
    terms: int = 3
    anneal_steps: int = 5000
    failures: int = 4096


@dataclass
class RateTables:
    """fit (one row: terms), fitted (t, activity), corrected (region, t, activity), sets, bounds, annealed (a row a source and region), means (a row a region)."""

    fit: DataFrame
    fitted: DataFrame
    corrected: DataFrame
    sets: DataFrame
    bounds: DataFrame
    annealed: DataFrame
    means: DataFrame


def corrected(regions: DataFrame, fitted: DataFrame, percent: float) -> DataFrame:
    """(region, t, activity) of regions (region, t, activity) without their share of the fitted vessel's curve (t, activity) at the same times."""
    blood = F.broadcast(fitted.select("t", F.col("activity").alias("blood")))  # one curve: some tens of rows
    return regions.join(blood, "t").select("region", "t", kinetics.vascular_correction(F.col("activity"), F.col("blood"), percent).alias("activity"))


def even(rows: DataFrame, keys: list[str], step: float) -> DataFrame:
    """Curves (keys, t, activity) at times step apart from their first to their last, by monotone cubics."""
    ends = rows.groupBy(*keys).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    n = F.floor(F.round((F.col("last") - F.col("first")) / step, 6)).cast("int")
    grid = ends.select(*keys, "first", F.explode(F.sequence(F.lit(0), n)).alias("i")).select(*keys, F.round(F.col("first") + F.col("i") * step, 9).alias("t"))
    return curves.pchip_at(rows, grid, keys)


def rate_tables(vessel: DataFrame, regions: DataFrame, plan: RatePlan, path: str) -> tuple[Run, RateTables]:
    """vessel: (t, activity, sd, sigma), one curve; regions: (region, t, activity) at the same times.

    The fit of least error is taken. Where no fit, or no set of a copy, is good, the tables from there on are empty. Weights of
    the annealing are 1 / sqrt(sigma).
    """
    run, config = Run(vessel.sparkSession, path), asdict(plan)
    part = lambda name, keys, make: run.part(name, {k: config[k] for k in ["source", *keys]}, make)
    named = vessel.withColumn("curve_id", F.lit(1).cast("long"))
    top = F.struct(-F.col("activity"), F.col("t"))
    late = named.withColumn("peak", F.min(F.struct(top, F.col("t").alias("at"))).over(Window.partitionBy("curve_id"))["at"]).where(F.col("t") >= F.col("peak"))
    fit = part("fit", ["terms"], lambda: tracer.best_fits(tracer.fit_decays(late, terms=plan.terms)))
    own = named.select("curve_id", "t", "activity")
    whole = lambda: kinetics.full_curve(own, fit.select("curve_id", "terms"), ["curve_id"], min(plan.step, 0.1), with_peak=False)
    fitted = part("fitted", ["terms", "step"], lambda: curves.pchip_at(whole(), own.select("curve_id", "t"), ["curve_id"]).select("t", "activity").where("activity IS NOT NULL"))
    clean = part("corrected", ["terms", "step", "percent"], lambda: corrected(regions, fitted, plan.percent))
    sets = part("sets", ["terms", "step", "percent", "copies", "failures"], lambda: tracer.bootstrap(vessel, regions, plan.copies, plan.percent, plan.step, failures=plan.failures, terms=plan.terms))
    spread = lambda: kinetics.kde_fwhm(tracer.long_rates(sets), ["region", "param"], "value").select("region", "param", F.col("left").alias("low"), "peak", F.col("right").alias("high"))
    bounds = part("bounds", ["terms", "step", "percent", "copies", "failures"], spread)

    def search() -> DataFrame:
        weights = even(named.select("curve_id", "t", (1 / F.sqrt("sigma")).alias("activity")), ["curve_id"], plan.step).select("t", F.col("activity").alias("weight"))
        rows = even(clean, ["region"], plan.step).join(F.broadcast(weights), "t")  # one curve
        return tracer.anneal(rows.select("region", "t", "activity", "weight"), bounds, plan.step, plan.anneal_steps)

    annealed = part("annealed", list(config), search)
    means = part("means", list(config), lambda: annealed.groupBy("region").agg(*[F.avg(c).alias(c) for c in ("k1", "k2", "k3", "ki")], F.count("*").alias("sources")))
    return run, RateTables(fit, fitted, clean, sets, bounds, annealed, means)
