"""Queries of inputs and of summaries: which files are read, log lines, weights, curve text, resampled curves. Registered with those of catalogue.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.functions import curves
from kinespark.operators import clusters, components, kinetics
from kinespark.plans import catalogue, proxies, stage_queries  # noqa: F401  (q_resampled takes SQL that it registers)
from kinespark.plans.catalogue import ORACLES, TRAITS, frame_time, query, r6
from kinespark.plans.proxies import sql
from kinespark.sources import inputs, tables

#: Each page is a file of a subject (two pages are one); the length of its address says which.
FILES = """WITH p AS (SELECT page_id, 's' || (page_id // 2) AS subject, length(url) % 6 AS kind FROM pages),
f AS (SELECT subject, CASE kind WHEN 0 THEN 'tacs.txt' WHEN 1 THEN 'raw/sub-' || subject || '.tacs.tsv' WHEN 2 THEN subject || '.TACs' WHEN 3 THEN 'ses-fdg' || (page_id % 10) || '_tacs/out_file/wmparc_reoriented_tacs.tsv' WHEN 4 THEN 'notes.txt' ELSE 'ses-fdg/x_tacs/out_file/wmparc_reoriented_tacs.tsv' END AS path,
  CASE kind WHEN 0 THEN 7 WHEN 1 THEN 1 WHEN 2 THEN 4 WHEN 3 THEN 0 END AS place FROM p),
r AS (SELECT subject, arg_min(path, (place, path)) AS path, CAST(min(place) AS INT) AS place, count(*) - 1 AS ignored FROM (SELECT DISTINCT * FROM f WHERE place IS NOT NULL) GROUP BY subject)
"""


def _files(spark, d) -> DataFrame:
    i, s = F.col("page_id"), F.concat(F.lit("s"), F.floor(F.col("page_id") / 2).cast("string"))
    kind = F.length("url") % 6
    deep = F.concat(F.lit("ses-fdg"), (i % 10).cast("string"), F.lit("_tacs/out_file/wmparc_reoriented_tacs.tsv"))
    path = F.when(kind == 0, "tacs.txt").when(kind == 1, F.concat(F.lit("raw/sub-"), s, F.lit(".tacs.tsv"))).when(kind == 2, F.concat(s, F.lit(".TACs")))
    path = path.when(kind == 3, deep).when(kind == 4, "notes.txt").otherwise("ses-fdg/x_tacs/out_file/wmparc_reoriented_tacs.tsv")
    return proxies.read(spark, d, "pages").select(s.alias("subject"), path.alias("path"))


@query(FILES + "SELECT subject, path, place, ignored FROM r")
def q_resolved_files(spark, d):
    return inputs.resolve(_files(spark, d), "tacs", "FDG")


@query(FILES + "SELECT DISTINCT subject FROM f WHERE subject NOT IN (SELECT subject FROM r)")
def q_missing_files(spark, d):
    files = _files(spark, d)
    return inputs.missing(files, inputs.resolve(files, "tacs", "FDG"), ["subject"])


@query("""WITH e AS (SELECT event_id, user_id, event_type FROM events WHERE event_type = 'purchase')
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS step, CAST(user_id % 9 + 1 AS INT) AS orig_label, CASE WHEN event_id % 3 = 0 THEN 4 ELSE 10 END AS orig_k, event_id % 50 + 0.5e0 AS orig_peak, CAST(event_id % 7 AS INT) AS orig_t, 26 AS orig_t_len, CAST(user_id % 40 AS INT) AS orig_blobs, 12.5e0 AS orig_vox_per_blob,
CAST(user_id % 5 + 1 AS INT) AS final_label, 14 AS final_k, event_id % 50 + 3.25e0 AS final_peak, CAST(event_id % 7 + 1 AS INT) AS final_t, 26 AS final_t_len, CAST(user_id % 20 AS INT) AS final_blobs, 40.0e0 AS final_vox_per_blob FROM e""")
def q_alternates_taken(spark, d):
    def one(label: Column, k: Column, peak: Column, t: Column, blobs: Column, size: str) -> list[Column]:
        words = ["centroid ", label, "/", k, ": peak=", peak, " @ t=", t, "/26, ", blobs, f" blobs w/~{size} voxels"]
        return [F.lit(w) if isinstance(w, str) else w.cast("string") for w in words]

    e, u = F.col("event_id"), F.col("user_id")
    first = one(u % 9 + 1, F.when(e % 3 == 0, 4).otherwise(10), F.concat((e % 50).cast("string"), F.lit(".5")), e % 7, u % 40, "12.5")
    second = one(u % 5 + 1, F.lit(14), F.concat((e % 50 + 3).cast("string"), F.lit(".25")), e % 7 + 1, u % 20, "40.0")
    line = F.when(F.col("event_type") == "purchase", F.concat(F.lit("INFO alternate for "), *first, F.lit(" is "), *second)).otherwise(F.concat(*first))
    found = tables.alternates_taken(proxies.read(spark, d, "events").select("event_id", line.alias("value")))
    fields = ("label", "k", "peak", "t", "t_len", "blobs", "vox_per_blob")
    return found.select("event_id", "step", *[F.col(f"{which}.{f}").alias(f"{which}_{f}") for which in ("orig", "final") for f in fields])


_TIMES = ", ti AS (SELECT DISTINCT region, frame, frame * frame / 64e0 AS t, frame % 7 <> 0 AS used FROM tac), w AS (SELECT *, least(t - lag(t, 1, 0e0) OVER o, lead(t, 1, 999999999.9e0) OVER o - t) AS duration FROM ti WINDOW o AS (PARTITION BY region ORDER BY t))"


def _timing(spark, d) -> DataFrame:
    times = proxies.regional_curves(spark, d).select("region", frame_time(F.col("frame")).alias("t"), (F.col("frame") % 7 != 0).alias("used")).distinct()
    return curves.timing(times, ["region"])


@query(sql("tac") + _TIMES + " SELECT region, t AS t_mid, round(sqrt(duration), 6) AS by_root, round(duration, 6) AS by_length FROM w WHERE used")
def q_frame_weights(spark, d):
    timed = _timing(spark, d)
    length = curves.weights(timed, by_root=False).select("region", "t_mid", F.col("weight").alias("by_length"))
    return curves.weights(timed).join(length, ["region", "t_mid"]).select("region", "t_mid", r6(F.col("weight"), "by_root"), r6(F.col("by_length"), "by_length"))


@query(sql("tac") + _TIMES + """, p AS (SELECT region, arg_min(frame, (-activity, frame)) AS top FROM tac GROUP BY region)
SELECT region, frame >= top AS after_peak, count(*) AS n, round(sum(activity), 8) AS activity, round(sum(sqrt(duration)), 6) AS weight, round(sum(1 / sqrt(sqrt(duration))), 6) AS sigma, round(sum(duration), 6) AS duration FROM tac JOIN w USING (region, frame) JOIN p USING (region) GROUP BY ALL""")
def q_peak_halves(spark, d):
    rows = curves.with_peak(proxies.regional_curves(spark, d), ["region"]).withColumn("t_mid", frame_time(F.col("frame")))
    both = rows.join(_timing(spark, d), ["region", "t_mid"]).groupBy("region", "after_peak")
    return both.agg(F.count("*").alias("n"), F.round(F.sum("activity"), 8).alias("activity"), *[r6(F.sum(c), c) for c in ("weight", "sigma", "duration")])


@query(sql("tac") + _TIMES + " SELECT frame, region, round(t - duration / 2, 6) AS t_start, round(t + duration / 2, 6) AS t_end, round(activity * duration, 6) AS counts FROM tac JOIN w USING (region, frame)")
def q_timed_curves(spark, d):
    rows = proxies.regional_curves(spark, d).withColumn("t_mid", frame_time(F.col("frame"))).join(_timing(spark, d), ["region", "t_mid"])
    return rows.select("frame", "region", r6(F.col("t_start"), "t_start"), r6(F.col("t_end"), "t_end"), r6(F.col("activity") * F.col("duration"), "counts"))


@query(sql("vox") + ", v AS (SELECT vox_id, frame, frame * frame / 64e0 AS t, activity FROM vox) SELECT vox_id, coalesce(regr_slope(activity, t) > 0, false) AS rising, coalesce(regr_slope(activity, t) FILTER (WHERE frame > 1) > 0, false) AS rising_later FROM v GROUP BY vox_id")
def q_rising(spark, d):
    rows = proxies.voxels(spark, d).withColumn("t", frame_time(F.col("frame")))
    return curves.rising(curves.lines(rows, ["vox_id"])).select("vox_id", "rising", "rising_later")


@query(TRAITS + "SELECT k, label, (CASE WHEN k IN (10, 18) THEN 60 ELSE 1 END) * (peak_index + 1) * (peak_index + 1) / 64e0 < CASE WHEN k IN (10, 18) THEN 600 ELSE 10 END AS early FROM t")
def q_early_peak(spark, d):
    seconds = F.col("k").isin(10, 18)
    t = F.when(seconds, 60.0).otherwise(1.0) * frame_time(F.col("peak_index") + 1)
    return catalogue._traits(spark, d).select("k", "label", (t < curves.early_limit(F.when(seconds, "s").otherwise("min"))).alias("early"))


@query(sql("tac") + "SELECT frame, round(avg(activity), 10) AS mean, round(stddev_pop(activity), 10) AS sd, round(min(activity), 8) AS low, round(max(activity), 8) AS high FROM tac GROUP BY frame")
def q_curve_ensemble(spark, d):
    rows = proxies.regional_curves(spark, d).groupBy("frame")
    # Sums of prices have 8 places; a mean of two or four of them has up to 10, and would be halfway between two values of 8.
    return rows.agg(*[F.round(f("activity"), n).alias(name) for f, n, name in ((F.avg, 10, "mean"), (F.stddev_pop, 10, "sd"), (F.min, 8, "low"), (F.max, 8, "high"))])


@query("""WITH s AS (SELECT l_returnflag AS region, avg(l_quantity) AS m, stddev_pop(l_quantity) AS sd, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1)
SELECT region, printf('mean %.1f +/- sd %.1f, 95%% [%.1f to %.1f] range [%.1f to %.1f]', m, sd, m - sd - sd, m + sd + sd, CAST(low AS DOUBLE), CAST(high AS DOUBLE)) AS text FROM s""")
def q_stat_text(spark, d):
    v = F.col("l_quantity").cast("double")
    text = curves.described(F.avg(v), F.stddev_pop(v), F.min(v), F.max(v))
    return proxies.read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("region")).agg(text.alias("text"))


@query(sql("clu") + ", v AS (SELECT vox_id, count(*) AS agreed FROM clu WHERE label <= 5 GROUP BY vox_id), h AS (SELECT agreed, count(*) AS n FROM v GROUP BY agreed) SELECT agreed, n, round(n / sum(n) OVER (), 6) AS share FROM h")
def q_agreement(spark, d):
    votes = proxies.labels(spark, d).where("label <= 5").groupBy("vox_id").agg(F.count("*").alias("agreed"))
    found = votes.groupBy("agreed").agg(F.count("*").alias("n"))
    whole = found.agg(F.sum("n").alias("all"))  # one row
    return found.crossJoin(F.broadcast(whole)).select("agreed", "n", r6(F.col("n") / F.col("all"), "share"))


@query(TRAITS + "SELECT t.k, t.peak_index - b.peak_index AS \"offset\", row_number() OVER (PARTITION BY t.k, t.peak_index ORDER BY t.peak_value DESC, t.label) AS place, t.label, round(t.peak_value, 6) AS peak_value FROM t JOIN b ON t.k = b.k AND t.peak_index > b.peak_index WHERE t.vascular")
def q_runners_up(spark, d):
    found = catalogue._traits(spark, d)
    later = clusters.runners_up(found, clusters.best_in_k(found), None)
    return later.withColumn("place", F.col("place").cast("long")).withColumn("peak_value", F.round("peak_value", 6))


@query(sql("boot") + """, s AS (SELECT region, unnest([{'c': 100 * avg(k1), 'rate': avg(k2)}, {'c': 90 * avg(k3) + 40, 'rate': avg(k3)}, {'c': 300 * avg(k2), 'rate': avg(k1)}]) AS x FROM boot GROUP BY region)
SELECT region, string_agg(printf('%.2fe^{%.2ft}', x.c, -x.rate), ' + ' ORDER BY x.c DESC) AS equation FROM s GROUP BY region""")
def q_equation(spark, d):
    term = lambda c, rate: F.struct(c.alias("c"), rate.alias("rate"))
    rows = proxies.rate_constants(spark, d).groupBy("region").agg(*[F.avg(c).alias(c) for c in ("k1", "k2", "k3")])
    terms = F.array(term(100 * F.col("k1"), F.col("k2")), term(90 * F.col("k3") + 40, F.col("k3")), term(300 * F.col("k2"), F.col("k1")))
    return rows.select("region", kinetics.equation(terms).alias("equation"))


@query(sql("vox") + "SELECT frame AS component, count(*) AS n, round(avg(activity), 6) AS mean, round(stddev_pop(activity), 6) AS sd, round(min(activity), 6) AS low, round(max(activity), 6) AS high FROM vox GROUP BY frame")
def q_component_stats(spark, d):
    """Whole curves as components: their frames."""
    scores = proxies.voxels(spark, d).select("vox_id", F.col("frame").alias("component"), F.col("activity").alias("score"))
    found = components.component_stats(scores)
    return found.select("component", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "low", "high")])


#: Minutes between a curve's samples.
EVERY = 0.37
_GRID = ORACLES["q_full_curve"].replace("frame * 0.5e0", f"frame * {EVERY}e0").replace("SELECT e.region, e.i, e.t, round(CASE", ", a AS (SELECT e.region, e.t, (CASE", 1).replace("END, 8) AS activity\n", "END) AS y\n")
_SLOPES = ORACLES["q_pchip"].split("frame * frame / 64e0 AS t, activity AS y FROM cent),\n", 1)[1].split("\ng AS", 1)[0].replace("k, label", "region").replace("c AS (", "cc AS (").replace("FROM c)", "FROM cc)").replace("e AS (", "ee AS (").replace("FROM e)", "FROM ee)").replace("s AS (", "ss AS (").replace("FROM s)", "FROM ss)")


@query(_GRID.replace("\n, a AS", ",\na AS") + "),\n" + _SLOPES.rstrip(",") + """,
q AS (SELECT *, t AS at FROM f WHERE h IS NOT NULL)
SELECT x.region, x.t, round((2 * u * u * u - 3 * u * u + 1) * y + (u * u * u - 2 * u * u + u) * h * d + (3 * u * u - 2 * u * u * u) * y1 + (u * u * u - u * u) * h * d1, 6) AS activity
FROM (SELECT c.region, c.t, (c.t - q.at) / q.h AS u, q.* EXCLUDE (region, t) FROM c ASOF JOIN q ON c.region = q.region AND c.t >= q.at) x""")
def q_resampled(spark, d):
    rows = proxies.regional_curves(spark, d).select("region", (F.col("frame") * F.lit(EVERY)).alias("t"), "activity")
    term = lambda c, rate: F.struct(F.lit(c).alias("c"), F.lit(rate).alias("rate"))
    fits = rows.select("region").distinct().withColumn("terms", F.array(term(30.0, 0.02), term(5.0, 0.3)))
    found = kinetics.resampled(rows, fits, ["region"])
    return found.withColumn("activity", F.round("activity", 6))


_KINDS = ["matched", "named", "cached", "volumes", "other"]
_LISTED = f"""WITH f AS (SELECT 's' || (page_id // 3) AS subject, {_KINDS}[CAST(length(url) % 5 + 1 AS INT)] AS kind, url AS path FROM pages), k AS (SELECT DISTINCT *, list_position({_KINDS}, kind) AS place FROM f WHERE kind <> 'other')"""


@query(_LISTED + """, b AS (SELECT subject, kind, place, CASE WHEN kind = 'volumes' THEN min(path) ELSE max(path) END AS path, CASE WHEN kind = 'volumes' THEN count(*) ELSE 1 END AS files FROM k GROUP BY subject, kind, place)
SELECT subject, arg_min(kind, place) AS kind, arg_min(path, place) AS path, arg_min(files, place) AS files FROM b GROUP BY subject""")
def q_image_source(spark, d):
    i = F.col("page_id")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.length("url") % 5 + 1).cast("int"))
    return inputs.image_source(proxies.read(spark, d, "pages").select(F.concat(F.lit("s"), F.floor(i / 3).cast("string")).alias("subject"), kind.alias("kind"), F.col("url").alias("path")))


@query("""WITH s AS (SELECT 's' || c_custkey AS subject, c_custkey AS i FROM customer),
n AS (SELECT subject, i, 20 + i % 3 - CASE WHEN i % 4 = 0 THEN 1 ELSE 0 END AS frames, 20 + i % 3 - CASE WHEN i % 5 = 0 THEN 1 ELSE 0 END AS times FROM s),
u AS (SELECT subject, CASE WHEN i % 3 = 0 THEN 'kBq' WHEN i % 3 = 1 THEN '' END AS option, CASE WHEN i % 2 = 0 THEN 'Bq/mL' END AS sidecar FROM s)
SELECT subject, 'no curves' AS what, true AS fatal, NULL AS detail FROM s WHERE i % 11 = 0 UNION ALL SELECT subject, 'no mid-times', true, NULL FROM s WHERE i % 13 = 0 UNION ALL SELECT subject, 'no image', true, NULL FROM s WHERE i % 17 = 0
UNION ALL SELECT subject, 'frames and times differ', true, frames || ' and ' || times FROM n WHERE frames <> times AND i % 13 <> 0 AND i % 17 <> 0
UNION ALL SELECT subject, 'no such region', false, 'caudate' FROM s WHERE i % 7 = 0 UNION ALL SELECT subject, 'units differ', false, option || ' and ' || sidecar FROM u WHERE option = 'kBq' AND sidecar IS NOT NULL""")
def q_failed_checks(spark, d):
    """Each customer is a subject, whose number says what its inputs lack."""
    i = F.col("i")
    s = proxies.read(spark, d, "customer").select(F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("subject"), F.col("c_custkey").alias("i"))
    subjects = s.select("subject")
    numbered = s.withColumn("frame", F.explode(F.sequence(F.lit(1), (F.lit(20) + i % 3).cast("int"))))
    frames = numbered.where(i % 17 != 0).select("subject", ((i % 4 != 0) | (F.col("frame") > 1)).alias("used"))
    times = numbered.where(i % 13 != 0).select("subject", ((i % 5 != 0) | (F.col("frame") > 1)).alias("used"))
    regions = s.select("subject", "i", F.explode(F.array(F.lit("caudate"), F.lit("putamen"))).alias("region"))
    units = inputs.used_units(s.select("subject", F.when(i % 3 == 0, "kBq").when(i % 3 == 1, "").alias("option"), F.when(i % 2 == 0, "Bq/mL").alias("sidecar")))
    return inputs.failed_checks(subjects, s.where(i % 11 != 0).select("subject"), times, frames, regions.select("subject", "region"), regions.where((i % 7 != 0) | (F.col("region") == "putamen")), units)
