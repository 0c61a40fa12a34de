"""Operations on curves in long form (keys..., frame or t, activity). Each is one shuffle on the curves' keys at most."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAST_NEXT = 999999999.9


def peak(curves: DataFrame, keys: list[str], at: str = "frame", value: str = "activity") -> DataFrame:
    """The first highest sample of each curve: peak_index (its place in at) and peak_value."""
    best = F.min_by(F.struct(F.col(at), F.col(value)), F.struct(-F.col(value), F.col(at)))
    return curves.groupBy(*keys).agg(best.alias("best")).select(*keys, F.col(f"best.{at}").alias("peak_index"), F.col(f"best.{value}").alias("peak_value"))


def with_peak(curves: DataFrame, keys: list[str], at: str = "frame", value: str = "activity") -> DataFrame:
    """Each sample with its curve's peak_index and whether it is after_peak; the peak itself belongs to the part after it."""
    top = F.min(F.struct((-F.col(value)).alias("v"), F.col(at).alias("at"))).over(Window.partitionBy(*keys))["at"]
    return curves.withColumn("peak_index", top).withColumn("after_peak", F.col(at) >= F.col("peak_index"))


def auc(curves: DataFrame, keys: list[str], t: str = "t", value: str = "activity") -> DataFrame:
    """The area under each curve by trapezoids."""
    w = Window.partitionBy(*keys).orderBy(t)
    part = (F.col(value) + F.lag(value).over(w)) / 2 * (F.col(t) - F.lag(t).over(w))
    return curves.select(*keys, part.alias("part")).groupBy(*keys).agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("auc"))


def lines(curves: DataFrame, keys: list[str], t: str = "t", value: str = "activity", at: str = "frame") -> DataFrame:
    """Slope and intercept of the least-squares line through each curve, whole and without the first sample."""
    later = F.col(at) > 1
    y, x = F.when(later, F.col(value)), F.when(later, F.col(t))
    return curves.groupBy(*keys).agg(F.regr_slope(value, t).alias("whole_slope"), F.regr_intercept(value, t).alias("whole_intercept"), F.regr_slope(y, x).alias("wo_first_slope"), F.regr_intercept(y, x).alias("wo_first_intercept"))


def timing(times: DataFrame, keys: list[str], t: str = "t", used: str = "used") -> DataFrame:
    """Each mid-time's duration (the lesser distance to its neighbours), start, end, and the weight and sigma it gives."""
    w = Window.partitionBy(*keys).orderBy(t)
    mid = F.col(t)
    duration = F.least(mid - F.lag(t, 1, 0.0).over(w), F.lead(t, 1, LAST_NEXT).over(w) - mid)
    found = times.withColumn("duration", duration)
    d = F.col("duration")
    return found.select(*keys, (mid - d / 2).alias("t_start"), mid.alias("t_mid"), (mid + d / 2).alias("t_end"), "duration", used, F.sqrt(d).alias("weight"), (1 / F.sqrt(F.sqrt(d))).alias("sigma"))


def weights(timed: DataFrame, by_root: bool = True) -> DataFrame:
    """The used rows of timing with the weight of their duration: its root, or itself."""
    return timed.where("used").withColumn("weight", F.sqrt("duration") if by_root else F.col("duration"))


def rising(found: DataFrame) -> DataFrame:
    """lines with whether the curve rises, whole and without its first sample: what has no slope (one sample) doesn't."""
    up = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    return found.withColumns({"rising": up("whole_slope"), "rising_later": up("wo_first_slope")})


def early_limit(units: Column, minutes: float = 10.0) -> Column:
    """The latest time of an early peak in the units of time: seconds if their name starts with s, else minutes."""
    return F.when(F.lower(units).startswith("s"), F.lit(60.0 * minutes)).otherwise(F.lit(float(minutes)))


def described(mean: Column, sd: Column, low: Column, high: Column) -> Column:
    """A line on values: mean, sd, the range of two sd about the mean, and the whole range."""
    return F.format_string("mean %.1f +/- sd %.1f, 95%% [%.1f to %.1f] range [%.1f to %.1f]", mean, sd, mean - sd - sd, mean + sd + sd, low, high)


def uniform(times: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """Whether each curve's steps are equal to 4 decimals."""
    step = F.round((F.col(t) - F.lag(t).over(Window.partitionBy(*keys).orderBy(t))) * 10000)
    return times.select(*keys, step.alias("step")).groupBy(*keys).agg((F.count_distinct("step") == 1).alias("uniform"))


def interpolate(curves: DataFrame, grid: DataFrame, keys: list[str], t: str = "t", value: str = "activity", extrapolate: bool = False) -> DataFrame:
    """Linear interpolation of each curve at grid (keys, t): an as-of join by one window over knots and grid points.

    Beyond the ends the value is the end's, or, with extrapolate, on the line through the two nearest knots. Several
    samples at one time count as their mean.
    """
    knots = curves.groupBy(*keys, t).agg(F.avg(value).alias("y"))
    w = Window.partitionBy(*keys).orderBy(t)
    ends = knots.withColumn("t_next", F.lead(t).over(w)).withColumn("y_next", F.lead("y").over(w)).withColumn("first", F.row_number().over(w) == 1)
    both = ends.select(*keys, t, F.struct(F.col(t).alias("t"), "y", "t_next", "y_next").alias("knot"), F.lit(0).alias("kind")).unionByName(grid.select(*keys, t, F.lit(None).cast(ends.select(F.struct(F.col(t).alias("t"), "y", "t_next", "y_next")).schema[0].dataType).alias("knot"), F.lit(1).alias("kind")))
    before = Window.partitionBy(*keys).orderBy(t, "kind").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(t, F.desc("kind")).rowsBetween(0, Window.unboundedFollowing)
    placed = both.withColumn("a", F.last("knot", True).over(before)).withColumn("b", F.first("knot", True).over(after)).where("kind = 1")
    x = F.col(t)
    inside = F.when(F.col("a.t_next").isNull(), F.col("a.y")).otherwise(F.col("a.y") + (x - F.col("a.t")) * (F.col("a.y_next") - F.col("a.y")) / (F.col("a.t_next") - F.col("a.t")))
    start = F.col("b.y") + (x - F.col("b.t")) * (F.col("b.y_next") - F.col("b.y")) / (F.col("b.t_next") - F.col("b.t")) if extrapolate else F.col("b.y")
    return placed.select(*keys, t, F.when(F.col("a").isNull(), start).otherwise(inside).alias(value))


def _intervals(curves: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """Each knot with the interval after it: its length h, the slope d at the knot (Fritsch-Carlson), and d1 and y1 at the next."""
    w = Window.partitionBy(*keys).orderBy(t)
    h, y = F.lead(t).over(w) - F.col(t), F.col(value)
    a = curves.withColumn("h", h).withColumn("m", (F.lead(value).over(w) - y) / h)
    a = a.withColumn("h0", F.lag("h").over(w)).withColumn("m0", F.lag("m").over(w)).withColumn("h1", F.lead("h").over(w)).withColumn("m1", F.lead("m").over(w)).withColumn("h00", F.lag("h", 2).over(w)).withColumn("m00", F.lag("m", 2).over(w))

    def end(h: str, h1: str, m: str, m1: str) -> Column:
        d = ((2 * F.col(h) + F.col(h1)) * F.col(m) - F.col(h) * F.col(m1)) / (F.col(h) + F.col(h1))
        d = F.when(F.signum(d) != F.signum(m), 0.0).when((F.signum(m) != F.signum(m1)) & (F.abs(d) > 3 * F.abs(m)), 3 * F.col(m)).otherwise(d)
        return F.when(F.col(h1).isNull(), F.col(m)).otherwise(d)

    w1, w2 = 2 * F.col("h") + F.col("h0"), F.col("h") + 2 * F.col("h0")
    middle = F.when(F.col("m0") * F.col("m") <= 0, 0.0).otherwise((w1 + w2) / (w1 / F.col("m0") + w2 / F.col("m")))
    slope = F.when(F.col("m0").isNull(), end("h", "h1", "m", "m1")).when(F.col("m").isNull(), end("h0", "h00", "m0", "m00")).otherwise(middle)
    return a.withColumn("d", slope).withColumn("d1", F.lead("d").over(w)).withColumn("y1", F.lead(value).over(w))


def _cubic(u: Column, h: Column, y: Column, d: Column, y1: Column, d1: Column) -> Column:
    """The monotone cubic at the share u of an interval."""
    return (2 * u * u * u - 3 * u * u + 1) * y + (u * u * u - 2 * u * u + u) * h * d + (3 * u * u - 2 * u * u * u) * y1 + (u * u * u - u * u) * h * d1


def pchip(curves: DataFrame, keys: list[str], t: str = "t", value: str = "activity", steps: int = 2) -> DataFrame:
    """Monotone cubic interpolation (Fritsch-Carlson slopes) at steps even points of each interval, and at the last knot."""
    y, b = F.col(value), _intervals(curves, keys, t, value)
    s = F.explode(F.when(F.col("h").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(steps - 1)))).alias("step")
    c = b.select(*keys, t, value, "h", "d", "d1", "y1", s).withColumn("s", F.col("step") / F.lit(float(steps)))
    u = F.col("s")
    cubic = _cubic(u, F.col("h"), y, F.col("d"), F.col("y1"), F.col("d1"))
    return c.select(*keys, (F.col(t) + u * F.coalesce("h", F.lit(0.0))).alias(t), F.when(u == 0, y).otherwise(cubic).alias(value))


def pchip_at(curves: DataFrame, grid: DataFrame, keys: list[str], t: str = "t", value: str = "activity") -> DataFrame:
    """The monotone cubic through each curve at grid (keys, t): an as-of join by one window. Beyond the ends the outermost cubics
    go on; a curve of one knot has its value everywhere, and keys without a curve give null."""
    w = Window.partitionBy(*keys).orderBy(t)
    names = ["at", "h", "y", "d", "y1", "d1"]
    b = _intervals(curves, keys, t, value).withColumn("at", F.col(t)).withColumn("y", F.col(value))
    own = F.struct(*names)
    # The last knot stands for the interval before it.
    b = b.withColumn("own", own).withColumn("knot", F.when(F.col("h").isNull(), F.coalesce(F.lag("own").over(w), F.col("own"))).otherwise(F.col("own")))
    knots = b.select(*keys, t, "knot", F.lit(0).alias("kind"))
    both = knots.unionByName(grid.select(*keys, t, F.lit(None).cast(knots.schema["knot"].dataType).alias("knot"), F.lit(1).alias("kind")))
    before = Window.partitionBy(*keys).orderBy(t, "kind").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(t, F.desc("kind")).rowsBetween(0, Window.unboundedFollowing)
    knot = F.coalesce(F.last("knot", True).over(before), F.first("knot", True).over(after))
    placed = both.withColumn("knot", knot).where("kind = 1")
    k = lambda name: F.col(f"knot.{name}")
    cubic = _cubic((F.col(t) - k("at")) / k("h"), *[k(n) for n in names[1:]])
    return placed.select(*keys, t, F.when(k("h").isNull(), k("y")).otherwise(cubic).alias(value))


def convolve(curves: DataFrame, kernel: Callable[[Column], Column], keys: list[str], at: str = "frame", value: str = "activity", step: float = 1.0) -> DataFrame:
    """Causal convolution with a kernel, a function of the lag: y[n] = step * sum of kernel(n - j) x[j] over j up to n.

    A curve is put together as an array of its frames by one shuffle and convolved in its row. Null values add nothing.
    """
    whole = curves.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(value).alias("x")))).alias("curve"))
    part = lambda n, p: F.coalesce(kernel(n["at"] - p["at"]) * p["x"], F.lit(0.0))
    total = lambda n: F.aggregate(F.filter("curve", lambda p: p["at"] <= n["at"]), F.lit(0.0), lambda s, p: s + part(n, p))
    found = F.transform("curve", lambda n: F.struct(n["at"].alias("at"), (total(n) * F.lit(step)).alias("y")))
    return whole.select(*keys, F.explode(found).alias("found")).select(*keys, F.col("found.at").alias(at), F.col("found.y").alias(value))


def set_curves(sets: DataFrame, keys: list[str], times: DataFrame, tag: str, source: str) -> DataFrame:
    """(keys, src, t, curve_id, activity) of sets of curves (keys, curve: a number, values: an array), at the times that their length tells.

    times: (keys, t, after_peak). Curves as long as all times of their keys have these, curves as long as those from the peak on
    have those. Any other length is an error, which names all three. Curves are called _0000_tag, by their number.
    """
    late = F.sort_array(F.collect_list(F.when(F.col("after_peak"), F.col("t"))))
    both = times.groupBy(*keys).agg(F.sort_array(F.collect_list("t")).alias("all_t"), late.alias("late_t"))  # some tens of frames
    rows = sets.join(both, keys, "left")
    n, whole, part = (F.coalesce(F.size(c), F.lit(0)) for c in ("values", "all_t", "late_t"))
    wrong = F.raise_error(F.format_string("curves of %d values match neither all %d times nor the %d from the peak on", n, whole, part)).cast("array<double>")
    t = F.when((n == whole) & (n > 0), F.col("all_t")).when((n == part) & (n > 0), F.col("late_t")).otherwise(wrong)
    at = F.explode(F.arrays_zip(t.alias("t"), F.col("values").alias("activity"))).alias("at")
    return rows.select(*keys, F.lit(source).alias("src"), F.format_string(f"_%04d_{tag}", "curve").alias("curve_id"), at).select(*keys, "src", "at.t", "curve_id", "at.activity")


def winsorized(curves: DataFrame, keys: list[str], group: list[str], at: str = "frame", value: str = "activity", width: float = 2.0) -> DataFrame:
    """The curves of each group that have no sample outside mean +- width sd of the group's samples at its time."""
    stats = curves.groupBy(*group, at).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    near = F.abs(F.col(value) - F.col("mean")) <= width * F.col("sd")
    return curves.join(stats, [*group, at]).groupBy(*group, *keys).agg(F.bool_and(near).alias("inside")).where("inside").drop("inside")


def melt(wide: DataFrame, ids: list[str], values: list[str], name: str = "region", value: str = "activity") -> DataFrame:
    return wide.unpivot(ids, values, name, value)


def decay(t: Column, terms: list[tuple[float, float]]) -> Column:
    """The sum of c * exp(-rate * t)."""
    out = F.lit(0.0)
    for c, rate in terms:
        out = out + F.lit(c) * F.exp(F.lit(-rate) * t)
    return out


def units_in_millicuries(value: Column, unit: Column) -> Column:
    """Activities by unit (Bq, kBq or MBq a ml scale by 37 million, 37 thousand, 37); others pass through."""
    u = F.lower(unit)
    return F.when(u.isin("bq", "bq/ml", "bq/cc"), value / 37e6).when(u.isin("kbq", "kbq/ml", "kbq/cc"), value / 37e3).when(u.isin("mbq", "mbq/ml", "mbq/cc"), value / 37.0).otherwise(value)
