"""Queries of whole stages: cluster features and choices, kinetics from fits to annealing, inputs and sinks. Registered with those of catalogue.py."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinespark.functions import curves
from kinespark.operators import clusters, components, kinetics, lattice, rates, stages, tracer, two_step
from kinespark.plans import catalogue, proxies
from kinespark.plans.catalogue import CONFETTI, DENSITY, DICE, ORIGIN, RECURSIVE_TRAITS, REGIONS, TRAITS, ZOOM, query, r6
from kinespark.plans.proxies import sql
from kinespark.sources import tables
from kinespark.staging import stage_dir

_CFT = CONFETTI.removeprefix(DENSITY)
_DEN = DENSITY.split("den AS", 1)[1]
#: Traits, blobs and confetti scores of all clusters.
FEATURES = RECURSIVE_TRAITS.replace("xyz AS (SELECT vec_id AS vox_id, vec_id % 8", "xyz AS (SELECT vec_id AS vox_id, label, vec_id % 8") + ", den AS" + _DEN + _CFT
BEST = ", bb AS (SELECT t.* FROM t JOIN cft USING (k, label) WHERE vascular AND score <= 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY peak_index, peak_value DESC, label) = 1)"


def _features(spark, d) -> DataFrame:
    cells = proxies.labels(spark, d).join(proxies.lattice(spark, d).drop("label"), "vox_id")
    return stages.features(catalogue._centroids(spark, d), cells, catalogue.image_center(spark, d), ZOOM, ORIGIN)


@query(FEATURES + f""", im AS (SELECT sum(x * m) / sum(m) * {ZOOM}e0 AS px, sum(y * m) / sum(m) * {ZOOM}e0 AS py, sum(z * m) / sum(m) * {ZOOM}e0 + {ORIGIN}e0 AS pz FROM xyz JOIN (SELECT vec_id AS vox_id, list_avg(list_transform(embedding, lambda v: CAST(v AS DOUBLE) + 0.05e0)) AS m FROM embeddings) USING (vox_id)),
cm AS (SELECT k, label, avg(x) * {ZOOM}e0 AS cx, avg(y) * {ZOOM}e0 AS cy, avg(z) * {ZOOM}e0 + {ORIGIN}e0 AS cz FROM ce GROUP BY k, label)
SELECT t.k, t.label, peak_index, round(peak_value, 6) AS peak_value, vascular, round(score, 6) AS confetti_score, score > 0 AS likely_confetti, blobs, round(cx, 6) AS com_x, round(cy, 6) AS com_y, round(cz, 6) AS com_z,
round(sqrt((cx - px) * (cx - px) + (cy - py) * (cy - py) + (cz - pz) * (cz - pz)), 6) AS com_shift FROM t JOIN cft USING (k, label) JOIN bc USING (k, label) JOIN cm USING (k, label) CROSS JOIN im""")
def q_centroid_features(spark, d):
    rounded = ["peak_value", "confetti_score", "com_x", "com_y", "com_z", "com_shift"]
    found = _features(spark, d).select("k", "label", "peak_index", "peak_value", "vascular", "confetti_score", "likely_confetti", "blobs", "com_x", "com_y", "com_z", "com_shift")
    return found.select(*[F.round(c, 6).alias(c) if c in rounded else c for c in found.columns])


@query(FEATURES + BEST + "SELECT k, label, peak_index, round(peak_value, 6) AS peak_value FROM bb")
def q_best_in_k(spark, d):
    found = clusters.best_in_k(catalogue._traits(spark, d), catalogue._confetti(spark, d))
    return found.select("k", "label", "peak_index", r6(F.col("peak_value"), "peak_value"))


@query(FEATURES + BEST + f""", e AS (SELECT * FROM bb WHERE (peak_index + 1) * (peak_index + 1) / 64e0 < 40), m AS (SELECT peak_index FROM e GROUP BY peak_index ORDER BY count(*) DESC, peak_index LIMIT 1)
SELECT k, label, peak_index, round(peak_value, 6) AS peak_value FROM e JOIN m USING (peak_index) ORDER BY e.peak_value DESC, k, label LIMIT 1""")
def q_best_unscattered(spark, d):
    """The best of all clusters that aren't likely scattered, among those that peak before 40 minutes."""
    best = clusters.best_in_k(catalogue._traits(spark, d), catalogue._confetti(spark, d))
    return clusters.best_overall(best, catalogue.frame_time(F.col("peak_index") + 1), 40.0).withColumn("peak_value", F.round("peak_value", 6))


def two_step_run(spark, d, path: str, **changed):
    """The whole two-step clustering of the voxels, raised so that no mean curve is negative, with every cluster count of the sweep."""
    plan = two_step.Plan(d, zoom=ZOOM, origin=ORIGIN, keep_confetti_first=True, peak_limit=100.0, **changed)
    points = catalogue._points(spark, d).withColumn("point", F.transform("point", lambda x: x + 0.6))
    return two_step.two_step(points, proxies.lattice(spark, d).drop("label"), plan, path, lambda i: catalogue.frame_time(i + 1))


@query()
def q_two_step_run(spark, d):
    found = two_step_run(spark, d, f"{stage_dir(spark)}/two-step-{uuid.uuid4().hex}")[-1]
    return found.select("k", "label", "frame", "voxel_count", r6(F.col("activity"), "activity"), r6(F.col("sd"), "sd"), "best")


@query(TRAITS.rstrip() + ",\nsz AS" + DICE.split(", sz AS", 1)[1] + """SELECT k1 AS k, label1 AS label, round(coalesce(sum(dice) FILTER (WHERE b.k IS NOT NULL), 0) / (SELECT count(*) FROM b), 6) AS matches_best,
CAST(count(*) FILTER (WHERE k1 <> k2 AND dice > 0.5e0) AS BIGINT) AS n_overlapping FROM dice LEFT JOIN b ON b.k = k2 AND b.label = label2 GROUP BY k1, label1""")
def q_matches_best(spark, d):
    found = clusters.matches_best(clusters.dice(proxies.labels(spark, d)), clusters.best_in_k(catalogue._traits(spark, d)))
    return found.select("k", "label", r6(F.col("matches_best"), "matches_best"), F.size("overlapping").cast("long").alias("n_overlapping"))


@query(TRAITS + "SELECT k, CAST(count(*) FILTER (WHERE vascular) AS BIGINT) AS n_vascular, count(*) AS n FROM t GROUP BY k")
def q_vascular_per_k(spark, d):
    return catalogue._traits(spark, d).groupBy("k").agg(F.count_if("vascular").alias("n_vascular"), F.count("*").alias("n"))


@query(TRAITS + "SELECT t.k, t.label, t.voxel_count, t.voxel_count > 15 AS large FROM t JOIN b USING (k, label) WHERE t.vascular AND (t.k > 15 OR t.k = 1)")
def q_stats_filter(spark, d):
    best = clusters.best_in_k(catalogue._traits(spark, d))
    return best.where("vascular AND (k > 15 OR k = 1)").select("k", "label", "voxel_count", (F.col("voxel_count") > 15).alias("large"))


@query(RECURSIVE_TRAITS + """, sp AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY k, label ORDER BY n DESC, blob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER (PARTITION BY k, label) AS prev_share FROM bs),
kept AS (SELECT cb.k, cb.label, cb.vox_id FROM cb JOIN sp USING (k, label, blob) JOIN t USING (k, label) WHERE vascular AND prev_share <= 0.95e0)
SELECT kept.k, kept.label, vox.frame, count(*) AS voxel_count, round(avg(activity), 6) AS activity, round(any_value(bq.n) / count(*), 6) AS reduced_ratio FROM kept JOIN vox USING (vox_id) JOIN (SELECT k, label, count(*) AS n FROM clu GROUP BY ALL) bq ON bq.k = kept.k AND bq.label = kept.label GROUP BY kept.k, kept.label, vox.frame""")
def q_reduced_clusters(spark, d):
    cells = proxies.labels(spark, d).join(proxies.lattice(spark, d).drop("label"), "vox_id")
    found = stages.reduced(cells, catalogue._traits(spark, d), proxies.voxels(spark, d))
    return found.select("k", "label", "frame", "voxel_count", r6(F.col("activity"), "activity"), r6(F.col("reduced_ratio"), "reduced_ratio"))


@query(TRAITS + """, msk AS (SELECT vec_id AS vox_id FROM embeddings WHERE label = 2), new AS (SELECT 1 AS k, 1 AS label, frame, avg(activity) AS activity, count(*) AS voxel_count FROM vox JOIN msk USING (vox_id) GROUP BY frame)
SELECT k, label, frame, round(activity, 6) AS activity, voxel_count FROM new UNION ALL SELECT cent.k, cent.label, cent.frame, round(activity, 6), voxel_count FROM cent JOIN size USING (k, label)""")
def q_override(spark, d):
    mask = proxies.lattice(spark, d).where("label = 2").select("vox_id")
    found = stages.overridden(catalogue._centroids(spark, d), proxies.voxels(spark, d), mask)
    return found.select("k", "label", "frame", r6(F.col("activity"), "activity"), "voxel_count")


@query(TRAITS + """, e AS (SELECT * FROM b WHERE (peak_index + 1) * (peak_index + 1) / 64e0 < 10), m AS (SELECT peak_index FROM e GROUP BY peak_index ORDER BY count(*) DESC, peak_index LIMIT 1),
one AS (SELECT k, label FROM e JOIN m USING (peak_index) ORDER BY e.peak_value DESC, k, label LIMIT 1),
inside AS (SELECT vox_id FROM clu JOIN one USING (k, label)), two AS (SELECT vec_id AS vox_id, (label * 5 + vec_id) % 4 + 1 AS label FROM embeddings WHERE vec_id IN (SELECT vox_id FROM inside))
SELECT label, frame, count(*) AS voxel_count, round(avg(activity), 6) AS activity, round(coalesce(stddev_pop(activity), 0), 6) AS sd FROM two JOIN vox USING (vox_id) GROUP BY label, frame""")
def q_two_step(spark, d):
    labels = proxies.labels(spark, d)
    best = clusters.best_overall(clusters.best_in_k(catalogue._traits(spark, d)), catalogue.frame_time(F.col("peak_index") + 1))
    second = proxies.read(spark, d, "embeddings").select(F.col("vec_id").alias("vox_id"), ((F.col("label") * 5 + F.col("vec_id")) % 4 + 1).alias("label"))
    found = stages.second_step(labels, best, second, proxies.voxels(spark, d))
    return found.select("label", "frame", "voxel_count", r6(F.col("activity"), "activity"), r6(F.col("sd"), "sd"))


@query(TRAITS + "SELECT CASE WHEN vascular THEN 'vascular' WHEN irreversible THEN 'irreversible' WHEN noise THEN 'noise' ELSE 'other' END AS bucket, count(*) AS n FROM t GROUP BY 1")
def q_mask_buckets(spark, d):
    return catalogue._traits(spark, d).groupBy(stages.bucket().alias("bucket")).agg(F.count("*").alias("n"))


STEP = 0.7
_RATES = "rates AS (SELECT ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][CAST(curve_id % 5 + 1 AS INT)] AS region, avg(k1) AS k1, avg(k2) * (1 + 0.1e0 * (curve_id % 5)) AS k2, avg(k3) AS k3 FROM boot GROUP BY curve_id % 5)"


def _rates(spark, d) -> DataFrame:
    """Rate constants of the five regions, from the proxies' curves."""
    i = F.col("curve_id") % 5
    name = F.element_at(F.array(*map(F.lit, REGIONS)), (F.col("i") + 1).cast("int"))
    rows = proxies.rate_constants(spark, d).withColumn("i", i).groupBy("i").agg(*[F.avg(c).alias(c) for c in ("k1", "k2", "k3")])
    return rows.select(name.alias("region"), "k1", (F.col("k2") * (1 + F.lit(0.1) * F.col("i"))).alias("k2"), "k3")


@query(sql("tac", "boot") + f""", {_RATES}, w AS (SELECT *, 1 / sqrt(frame) AS weight FROM tac),
p AS (SELECT s.region AS source, t.region AS target, s.k2 AS k2s, s.k3 AS k3s, t.k2 AS k2t, t.k3 AS k3t, t.k1 / s.k1 AS scale FROM rates s JOIN rates t ON s.region <> t.region),
q AS (SELECT *, -least(k3s, k2t + k3t) AS nu, -greatest(k3s, k2t + k3t) AS eps, k2s - k2t AS alpha, k3t * (k2s + k3s) - k3s * (k2t + k3t) AS beta FROM p),
z AS (SELECT *, (beta + alpha * eps) / (eps - nu) AS m FROM q),
f AS (SELECT source, target, a.frame, any_value(a.activity) AS activity, any_value(a.weight) AS weight,
  sum(scale * b.activity * ({STEP}e0 * ((alpha - m) * exp(nu * (a.frame - b.frame) * {STEP}e0) + m * exp(eps * (a.frame - b.frame) * {STEP}e0)) + CASE WHEN a.frame = b.frame THEN 1 ELSE 0 END)) AS fit
  FROM z JOIN w a ON a.region = target JOIN w b ON b.region = source AND b.frame <= a.frame GROUP BY source, target, a.frame),
pen AS (SELECT sum(abs(k1 * k3 / (k2 + k3) - 0.1e0)) AS penalty FROM rates)
SELECT source, round(sum(weight * (activity - fit) * (activity - fit)) + any_value(penalty), 4) AS cost FROM f CROSS JOIN pen GROUP BY source""")
def q_source_to_target(spark, d):
    rows = proxies.regional_curves(spark, d).withColumn("weight", 1 / F.sqrt("frame"))
    constants = _rates(spark, d)
    found = kinetics.source_to_target_cost(rows, constants, constants.select("region", F.lit(0.1).alias("ki")), STEP)
    return found.select("source", F.round("cost", 4).alias("cost"))


@query(sql("tac") + """, c AS (SELECT region, frame * 0.5e0 AS t, activity FROM tac), p AS (SELECT region, arg_min(t, (-activity, t)) AS peak, max(t) AS last FROM c GROUP BY region),
g AS (SELECT region, i, round(i * 0.1e0, 6) AS t, peak FROM (SELECT *, unnest(range(0, CAST(floor(round(last / 0.1e0, 6)) AS BIGINT) + 1)) AS i FROM p)),
k AS (SELECT c.*, lead(t) OVER w AS tn, lead(activity) OVER w AS an, row_number() OVER w AS place FROM c JOIN p USING (region) WHERE t <= peak WINDOW w AS (PARTITION BY region ORDER BY t)),
e AS (SELECT g.region, g.i, g.t, peak, n.t AS t0, n.activity AS a0, n.tn, n.an FROM g ASOF LEFT JOIN k n ON g.region = n.region AND g.t >= n.t),
s AS (SELECT region, t AS t0, activity AS a0, tn, an FROM k WHERE place = 1)
SELECT e.region, e.i, e.t, round(CASE WHEN e.t >= peak THEN 30 * exp(-0.02e0 * e.t) + 5 * exp(-0.3e0 * e.t) WHEN e.t0 IS NULL THEN s.a0 + (e.t - s.t0) * (s.an - s.a0) / (s.tn - s.t0) ELSE e.a0 + (e.t - e.t0) * (e.an - e.a0) / (e.tn - e.t0) END, 8) AS activity
FROM e JOIN s USING (region) WHERE e.t >= peak OR e.t0 IS NOT NULL OR s.tn IS NOT NULL""")
def q_full_curve(spark, d):
    rows = proxies.regional_curves(spark, d).select("region", (F.col("frame") * F.lit(0.5)).alias("t"), "activity")
    term = lambda c, rate: F.struct(F.lit(c).alias("c"), F.lit(rate).alias("rate"))
    fits = rows.select("region").distinct().withColumn("terms", F.array(term(30.0, 0.02), term(5.0, 0.3)))
    found = kinetics.full_curve(rows, fits, ["region"])
    return found.where("activity IS NOT NULL").select("region", F.col("i").cast("long").alias("i"), "t", F.round("activity", 8).alias("activity"))


@query(sql("tac") + "SELECT region, CASE WHEN frame * 0.5e0 > 5 THEN 'late' ELSE 'early' END AS panel, count(*) AS n FROM tac GROUP BY ALL UNION ALL SELECT region, 'late', count(*) FROM tac WHERE frame * 0.5e0 = 5 GROUP BY region")
def q_panels(spark, d):
    t = F.col("frame") * F.lit(0.5)
    rows = proxies.regional_curves(spark, d)
    # The sample at five minutes is in both panels.
    both = rows.select("region", F.when(t > 5, "late").otherwise("early").alias("panel")).groupBy("region", "panel").agg(F.count("*").alias("n"))
    return both.unionByName(rows.where(t == 5).groupBy("region").agg(F.count("*").alias("n")).withColumn("panel", F.lit("late")))


def _vessel(spark, d) -> DataFrame:
    """(t, activity, sd, sigma): a bolus whose samples rise and fall with the months' totals."""
    rows = proxies.regional_curves(spark, d).groupBy("frame").agg(F.sum("activity").alias("total"))
    t = F.col("frame") * F.lit(STEP)
    shape = F.lit(40.0) * t * F.exp(-t) + F.lit(20.0) * (1 - F.exp(-t)) * F.exp(F.lit(-0.06) * t)
    mean = F.avg("total").over(Window.partitionBy())  # one row a month
    return rows.select("frame", t.alias("t"), (shape * (1 + F.lit(0.02) * (F.col("total") / mean - 1))).alias("activity")).withColumn("sd", F.col("activity") * 0.03).withColumn("sigma", F.lit(1.0))


def _tissues(spark, d) -> DataFrame:
    """(region, t, activity): what the vessel's curve gives in each region, with a share of blood."""
    vessel = _vessel(spark, d)
    rows = vessel.select("frame", "t", "activity").crossJoin(F.broadcast(_rates(spark, d))).withColumn("rates", F.struct("k1", "k2", "k3"))
    kernel = lambda lag: kinetics.impulse_response(F.col("rates.k1"), F.col("rates.k2"), F.col("rates.k3"), lag * F.lit(STEP))
    pure = curves.convolve(rows, kernel, ["region", "rates"], step=STEP)
    blood = vessel.select("frame", "t", F.col("activity").alias("blood"))
    return pure.join(blood, "frame").select("region", "t", (F.lit(0.95) * F.col("activity") + F.lit(0.05) * F.col("blood")).alias("activity"))


def bootstrap_sets(spark, d) -> DataFrame:
    return tracer.bootstrap(_vessel(spark, d).select("t", "activity", "sd", "sigma"), _tissues(spark, d), step=STEP)


@query()
def q_bootstrap(spark, d):
    return bootstrap_sets(spark, d).drop("parameters")


@query()
def q_failure_records(spark, d):
    """Every failure of 60 copies with its parameters, kept as a table and summed up from there."""
    sets = tracer.bootstrap(_vessel(spark, d).select("t", "activity", "sd", "sigma"), _tissues(spark, d), n=60, step=STEP, each_failure=True)
    path = f"{stage_dir(spark)}/failures-{uuid.uuid4().hex}"
    tracer.append_failures(tracer.failure_records(sets), path)
    kept = spark.read.schema("copy int, reason string, region string, parameters array<double>, code int").parquet(path)
    return tracer.failure_summary(kept)


def rate_bounds(spark, d) -> DataFrame:
    """Each region's bounds and peak of k1, k2, k3 and ki, by the density of the good sets; no rows if no set is good."""
    found = kinetics.kde_fwhm(tracer.long_rates(bootstrap_sets(spark, d)), ["region", "param"], "value")
    return found.select("region", "param", F.col("left").alias("low"), "peak", F.col("right").alias("high"))


@query()
def q_anneal(spark, d):
    bounds = stages.written(rate_bounds(spark, d), "rate-bounds")
    t = F.col("t")
    rows = _tissues(spark, d).join(_vessel(spark, d).select("t", F.col("activity").alias("blood")), "t")
    return tracer.anneal(rows.select("region", "t", ((F.col("activity") - 0.05 * F.col("blood")) / 0.95).alias("activity"), (1 / F.sqrt(t)).alias("weight")), bounds, STEP)


@query(sql("tac", "boot") + """, p AS (SELECT flag, k1, k2, k3, k4, sqrt((k2 + k3 + k4) * (k2 + k3 + k4) - 4 * k2 * k4) AS root FROM (SELECT region AS flag, avg(k1) AS k1, avg(k2) AS k2, avg(k3) AS k3, avg(k3) / 4 AS k4 FROM boot GROUP BY 1)),
e AS (SELECT *, (k2 + k3 + k4 - root) / 2 AS slow, (k2 + k3 + k4 + root) / 2 AS fast FROM p)
SELECT flag, a.region, a.frame, round(sum(k1 / root * ((k3 + k4 - slow) * exp(-slow * (a.frame - b.frame)) + (fast - k3 - k4) * exp(-fast * (a.frame - b.frame))) * b.activity), 6) AS activity FROM tac a JOIN tac b ON a.region = b.region AND b.frame <= a.frame CROSS JOIN e GROUP BY ALL""")
def q_2tc_reversible(spark, d):
    """Curves of two compartments where the tracer also comes back: k4 over 0."""
    constants = proxies.rate_constants(spark, d).groupBy(F.col("region").alias("flag")).agg(*[F.avg(c).alias(c) for c in ("k1", "k2", "k3")]).withColumn("k4", F.col("k3") / 4)
    rows = proxies.regional_curves(spark, d).crossJoin(F.broadcast(constants))  # a few rows a region
    kernel = lambda lag: kinetics.impulse_response(*[F.col(f"rates.{c}") for c in ("k1", "k2", "k3")], lag, F.col("rates.k4"))
    rows = rows.select("flag", "region", "frame", "activity", F.struct("k1", "k2", "k3", "k4").alias("rates"))
    return curves.convolve(rows, kernel, ["flag", "region", "rates"]).select("flag", "region", "frame", r6(F.col("activity"), "activity"))


@query()
def q_rate_table(spark, d):
    """Mean rate constants of all regions, from the vessel's and the regions' curves, with 100 copies."""
    plan = rates.RatePlan(d, STEP, copies=100, anneal_steps=500)
    return rates.rate_tables(_vessel(spark, d).select("t", "activity", "sd", "sigma"), _tissues(spark, d), plan, f"{stage_dir(spark)}/rates-{uuid.uuid4().hex}")[1].means


@query("""WITH l AS (SELECT user_id, ts, event_id, 'run --axial-slices-to-clip ' || (event_id % 7) || ' end' AS line FROM events WHERE event_type = 'purchase')
SELECT u.user_id, coalesce(CAST(regexp_extract(arg_max(line, (ts, event_id)), '--axial-slices-to-clip ([0-9]+)', 1) AS INT), 0) AS clip FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN l ON l.user_id = u.user_id GROUP BY u.user_id""")
def q_clip_threshold(spark, d):
    rows = proxies.read(spark, d, "events")
    lines = rows.where("event_type = 'purchase'").select("user_id", F.struct("ts", "event_id").alias("file"), F.concat(F.lit("run --axial-slices-to-clip "), (F.col("event_id") % 7).cast("string"), F.lit(" end")).alias("value"))
    return tables.clip_threshold(lines, rows.select("user_id").distinct(), ["user_id"])


@query("""WITH p AS (SELECT page_id, '/out/sub-' || page_id || CASE page_id % 3 WHEN 0 THEN '_nosr' ELSE '_sr-' || (page_id % 5) END || '/clip-' || (page_id % 4) || CASE WHEN page_id % 2 = 0 THEN '/or-x' ELSE '' END AS path FROM pages)
SELECT page_id, CASE WHEN contains(path, '_nosr') THEN 0 ELSE CAST(page_id % 5 AS INT) END AS sr, CAST(page_id % 4 AS INT) AS clip, page_id % 2 = 0 AS overridden FROM p""")
def q_run_folders(spark, d):
    i = F.col("page_id")
    path = F.concat(F.lit("/out/sub-"), i.cast("string"), F.when(i % 3 == 0, "_nosr").otherwise(F.concat(F.lit("_sr-"), (i % 5).cast("string"))), F.lit("/clip-"), (i % 4).cast("string"), F.when(i % 2 == 0, "/or-x").otherwise(""))
    return tables.run_folders(proxies.read(spark, d, "pages").select("page_id", path.alias("path"))).drop("path")


@query("SELECT l_returnflag AS region, round(avg(l_quantity), 4) AS mean, round(avg(l_quantity) - 2 * stddev_pop(l_quantity), 4) AS low, round(avg(l_quantity) + 2 * stddev_pop(l_quantity), 4) AS high, CAST(count(*) FILTER (WHERE l_quantity > 45) AS DOUBLE) / count(*) AS share_high FROM lineitem GROUP BY 1")
def q_two_sd(spark, d):
    v = F.col("l_quantity").cast("double")
    near = lambda sign: F.round(F.avg(v) + F.lit(2.0 * sign) * F.stddev_pop(v), 4)
    return proxies.read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("region")).agg(F.round(F.avg(v), 4).alias("mean"), near(-1).alias("low"), near(1).alias("high"), (F.count_if(v > 45).cast("double") / F.count("*")).alias("share_high"))


@query(sql("vox") + """, s AS (SELECT vox_id, region, avg(activity) AS mean FROM vox GROUP BY ALL), z AS (SELECT region, avg(mean) AS m, stddev_pop(mean) AS sd FROM s GROUP BY region),
k AS (SELECT vox_id, region, CASE WHEN mean > m + 1.5e0 * sd THEN 'hi' WHEN mean < m - 1.5e0 * sd THEN 'lo' ELSE 'mid' END AS part FROM s JOIN z USING (region))
SELECT region, part, frame, round(avg(activity), 6) AS activity FROM (SELECT region, part, vox_id FROM k WHERE part <> 'mid' UNION ALL SELECT region, 'all', vox_id FROM k) q JOIN (SELECT vox_id, frame, activity FROM vox) USING (vox_id) GROUP BY ALL""")
def q_sd_parts(spark, d):
    found = stages.sd_parts(proxies.voxels(spark, d), ["region"], 1.5)
    return found.select("region", "part", "frame", r6(F.col("activity"), "activity"))


@query(f"WITH s AS (SELECT max(vec_id % 8) + 1 AS nx, max((vec_id // 8) % 8) + 1 AS ny, max(vec_id // 64) + 1 AS nz FROM embeddings) SELECT CAST(c AS INT) AS corner, {ZOOM}e0 * (c // 4) * nx AS wx, {ZOOM}e0 * (c // 2 % 2) * ny AS wy, {ZOOM}e0 * (c % 2) * nz + {ORIGIN}e0 AS wz FROM s CROSS JOIN (SELECT unnest(range(0, 8)) AS c)")
def q_world_corners(spark, d):
    shape = proxies.lattice(spark, d).agg(*[(F.max(c) + 1).alias(f"n{c}") for c in "xyz"])
    return lattice.world_corners(shape, [[ZOOM, 0, 0, 0], [0, ZOOM, 0, 0], [0, 0, ZOOM, ORIGIN]])


@query("SELECT event_type AS name FROM events UNION SELECT l_returnflag FROM lineitem")
def q_parameter_names(spark, d):
    rows = proxies.read(spark, d, "events").select(F.col("event_type").alias("name"))
    return rows.union(proxies.read(spark, d, "lineitem").select("l_returnflag")).distinct()


@query(sql("tac") + """, c AS (SELECT region, frame * 0.5e0 AS t, activity - 30 AS activity FROM tac), p AS (SELECT region, arg_min(t, (-activity, t)) AS peak, max(t) AS last FROM c GROUP BY region),
g AS (SELECT region, i, round(i * 0.2e0, 6) AS t, peak FROM (SELECT *, unnest(range(0, CAST(floor(round(last / 0.2e0, 6)) AS BIGINT) + 1)) AS i FROM p)),
k AS (SELECT c.*, lead(t) OVER w AS tn, lead(activity) OVER w AS an, row_number() OVER w AS place FROM c JOIN p USING (region) WHERE t < peak WINDOW w AS (PARTITION BY region ORDER BY t)),
s AS (SELECT region, activity AS a0 FROM k WHERE place = 1), e AS (SELECT g.region, g.i, g.t, peak, n.t AS t0, n.activity AS a0, n.tn, n.an FROM g ASOF LEFT JOIN k n ON g.region = n.region AND g.t >= n.t)
SELECT e.region, e.i, e.t, round(CASE WHEN e.t >= peak THEN 30 * exp(-0.02e0 * e.t) ELSE greatest(0, coalesce(CASE WHEN e.t0 IS NULL THEN s.a0 WHEN e.tn IS NULL THEN e.a0 ELSE e.a0 + (e.t - e.t0) * (e.an - e.a0) / (e.tn - e.t0) END, 0)) END, 6) AS activity
FROM e LEFT JOIN s USING (region)""")
def q_uniform_curve(spark, d):
    """Curves on an even grid, whose peak is no knot of their rise; what is below zero is zero there."""
    rows = proxies.regional_curves(spark, d).select("region", (F.col("frame") * F.lit(0.5)).alias("t"), (F.col("activity") - F.lit(30.0)).alias("activity"))
    fits = rows.select("region").distinct().withColumn("terms", F.array(F.struct(F.lit(30.0).alias("c"), F.lit(0.02).alias("rate"))))
    found = kinetics.full_curve(rows, fits, ["region"], 0.2, with_peak=False)
    return found.select("region", F.col("i").cast("long").alias("i"), "t", r6(F.col("activity"), "activity"))


_DRAW = "('0x' || substr(md5('7-0-' || (l_orderkey * 8 + l_linenumber)), 1, 8))::BIGINT / 4294967296e0"


@query(f"""WITH b AS (SELECT [{", ".join(repr(sum(math.exp(-1) / math.factorial(i) for i in range(n + 1))) + "e0" for n in range(12))}] AS below),
w AS (SELECT l_returnflag AS region, l_quantity AS value, len(list_filter(below, lambda x: u >= x)) AS w FROM (SELECT l_returnflag, CAST(l_quantity AS DOUBLE) AS l_quantity, {_DRAW} AS u FROM lineitem) CROSS JOIN b),
e AS (SELECT region, min(value) AS lo, (max(value) - min(value)) / 100 AS width FROM w WHERE w > 0 GROUP BY region),
h AS (SELECT region, CAST(least(99, floor((value - lo) / width)) AS INT) AS bin, CAST(sum(w) AS BIGINT) AS n, any_value(lo) AS lo, any_value(width) AS width FROM w JOIN e USING (region) WHERE w > 0 GROUP BY 1, 2)
SELECT region, bin, round(lo + bin * width, 6) AS low, round(lo + (bin + 1) * width, 6) AS high, n FROM h""")
def q_resampled_density(spark, d):
    """A draw with replacement of the quantities, as a histogram of 100 bins."""
    rows = proxies.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("region"), F.col("l_quantity").cast("double").alias("value"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row"))
    found = kinetics.resampled_density(rows.withColumn("w", kinetics.resample_weights(F.col("row"), 7)), ["region"], "value", "w")
    return found.select("region", "bin", r6(F.col("low"), "low"), r6(F.col("high"), "high"), F.col("n").cast("long").alias("n"))


@query(sql("xyz") + """, sc AS (SELECT vec_id AS vox_id, unnest(range(1, 7)) AS component, CAST(unnest(embedding[1:6]) AS DOUBLE) * CASE WHEN vec_id < 120 THEN 4e0 ELSE 1e0 END AS score FROM embeddings),
ed AS (SELECT component, quantile_cont(score, 0.95) AS edge FROM sc GROUP BY component), m AS (SELECT component, x, y, z FROM sc JOIN ed USING (component) JOIN xyz USING (vox_id) WHERE score > edge),
st AS (SELECT component, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM m GROUP BY component),
r AS (SELECT component, any_value(n) AS n, avg(CASE WHEN sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)) <= 2 * pow(3 * n / (4 * pi()), 1 / 3e0) THEN 1e0 ELSE 0e0 END) AS ratio FROM m JOIN st USING (component) GROUP BY component)
SELECT r.component, n, round(ratio, 6) AS ratio, r.component = (SELECT min(component) FROM r WHERE ratio > 0.8e0) AS chosen FROM r""")
def q_brain_component(spark, d):
    """How compact each component's strongest voxels are, and the first that is compact enough; scores are given."""
    v = F.col("vec_id")
    scores = proxies.read(spark, d, "embeddings").select(v.alias("vox_id"), F.posexplode(F.slice("embedding", 1, 6)).alias("at", "x"))
    scores = scores.select(F.lit("given").alias("algorithm"), "vox_id", (F.col("at") + 1).cast("long").alias("component"), (F.col("x").cast("double") * F.when(F.col("vox_id") < 120, 4.0).otherwise(1.0)).alias("score"))
    found = stages.written(components.containment(scores, proxies.lattice(spark, d).drop("label"), ["algorithm"]), "containment")
    first = components.brain_component(found, ["algorithm"], 0.8).select("component", F.lit(True).alias("chosen"))
    # No component is chosen where none is compact enough: null, as SQL has it.
    none = F.when(F.max(F.col("chosen").cast("int")).over(Window.partitionBy()).isNotNull(), F.coalesce("chosen", F.lit(False)))
    return found.join(first, "component", "left").select("component", "n", r6(F.col("ratio"), "ratio"), none.alias("chosen"))


@query()
def q_component_table(spark, d):
    """Statistics of all components of the three decompositions, and the first of each that is a brain's."""
    scores = stages.written(components.decompositions(catalogue._points(spark, d), catalogue.FRAMES), "decompositions")
    keys = ["algorithm", "components"]
    first = components.brain_component(components.containment(scores, proxies.lattice(spark, d).drop("label"), keys), keys).select(*keys, "component", F.lit(True).alias("brain"))
    found = components.component_stats(scores).join(first, [*keys, "component"], "left")
    return found.select(*keys, "component", "n", *[r6(F.col(c), c) for c in ("mean", "sd", "low", "high")], F.coalesce("brain", F.lit(False)).alias("brain"))


_TABLE = RECURSIVE_TRAITS + """, sp AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY k, label ORDER BY n DESC, blob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER (PARTITION BY k, label) AS prev_share FROM bs),
bl AS (SELECT k, label, count(*) AS blob_count, avg(n) AS voxels_per_blob, CAST(count(*) FILTER (WHERE prev_share <= 0.95e0) AS BIGINT) AS sparsity FROM sp GROUP BY k, label),
ct AS (SELECT k, label, frame, frame * frame / 64e0 AS tm, activity FROM cent),
ar AS (SELECT k, label, sum(part) AS auc FROM (SELECT k, label, (activity + lag(activity) OVER w) / 2 * (tm - lag(tm) OVER w) AS part FROM ct WINDOW w AS (PARTITION BY k, label ORDER BY tm)) GROUP BY k, label),
ln AS (SELECT k, label, regr_slope(activity, tm) AS whole_slope, regr_intercept(activity, tm) AS whole_intercept, regr_slope(activity, tm) FILTER (WHERE frame > 1) AS wo_first_slope, regr_intercept(activity, tm) FILTER (WHERE frame > 1) AS wo_first_intercept FROM ct GROUP BY k, label),
e AS (SELECT * FROM b WHERE (peak_index + 1) * (peak_index + 1) / 64e0 < 10), m AS (SELECT peak_index FROM e GROUP BY peak_index ORDER BY count(*) DESC, peak_index LIMIT 1),
one AS (SELECT k, label FROM e JOIN m USING (peak_index) ORDER BY e.peak_value DESC, k, label LIMIT 1)
SELECT 'proxy' AS subject, 1 AS step, t.k, t.label, printf('l-%d_k-%d', t.label, t.k) AS name, t.peak_index, round(t.peak_value, 6) AS peak_value, round(auc, 6) AS auc, t.voxel_count, CAST(sum(t.voxel_count) OVER (PARTITION BY t.k) AS BIGINT) AS voxels_in_img,
blob_count, round(voxels_per_blob, 6) AS voxels_per_blob, sparsity, b.k IS NOT NULL AS best_in_k, one.k IS NOT NULL AS best_overall, round(whole_slope, 6) AS whole_slope, round(whole_intercept, 6) AS whole_intercept, round(wo_first_slope, 6) AS wo_first_slope, round(wo_first_intercept, 6) AS wo_first_intercept, t.vascular
FROM t JOIN bl USING (k, label) JOIN ar USING (k, label) JOIN ln USING (k, label) LEFT JOIN b ON b.k = t.k AND b.label = t.label LEFT JOIN one ON one.k = t.k AND one.label = t.label"""


@query(_TABLE)
def q_cluster_table(spark, d):
    """All that is known of each cluster, as one table."""
    found, rows = catalogue._traits(spark, d), catalogue._centroids(spark, d).withColumn("t", catalogue.frame_time(F.col("frame")))
    best = clusters.best_in_k(found)
    overall = clusters.best_overall(best, catalogue.frame_time(F.col("peak_index") + 1))
    sizes = lattice.blob_sizes(catalogue.cluster_blobs(spark, d), ["k", "label"])
    made = clusters.table(found, rows, sizes, best, overall, {"subject": "proxy", "step": 1}).drop("noise", "irreversible", "background")
    return made.select(*[F.round(c, 6).alias(c) if kind == "double" else c for c, kind in made.dtypes])


@query(TRAITS + """SELECT frame * frame / 64e0 AS t, round(activity, 6) AS activity, t.k, t.label, 'clusters' AS source, 'n/a' AS name, false AS best_overall, b.k IS NOT NULL AS best_in_k, t.peak_index, t.vascular FROM cent JOIN t USING (k, label) LEFT JOIN b ON b.k = t.k AND b.label = t.label
UNION ALL SELECT frame * frame / 64e0, round(avg(activity), 6), 0, 0, 'n/a', CAST(region AS VARCHAR), false, false, NULL, NULL FROM vox GROUP BY region, frame""")
def q_curves_of_all_kinds(spark, d):
    """Curves of clusters and of regions in one table; what the regions' lack is filled in."""
    found = catalogue._traits(spark, d)
    own = clusters.long_table(found, catalogue._centroids(spark, d), clusters.best_in_k(found)).withColumn("source", F.lit("clusters"))
    regions = proxies.voxels(spark, d).groupBy("region", "frame").agg(F.avg("activity").alias("activity")).withColumn("name", F.col("region").cast("string"))
    timed = [rows.withColumn("t", catalogue.frame_time(F.col("frame"))) for rows in (own, regions)]
    return clusters.plottable(*timed, features=("peak_index", "vascular")).withColumn("activity", F.round("activity", 6))


@query(sql("tac") + """, p AS (SELECT region, arg_min(frame, (-activity, frame)) AS top FROM tac GROUP BY region), a AS (SELECT region, frame * frame / 64e0 AS t, activity, frame >= top AS late FROM tac JOIN p USING (region))
SELECT region, 'tissue' AS src, t, '_0000_t' AS curve_id, round(activity, 8) AS activity FROM a UNION ALL SELECT region, 'tissue', t, '_0001_t', round(activity / 2, 10) FROM a WHERE late""")
def q_set_curves(spark, d):
    """A whole curve of each region, and half of its part from the peak on, each at the times that its length tells."""
    rows = curves.with_peak(proxies.regional_curves(spark, d), ["region"]).withColumn("t", catalogue.frame_time(F.col("frame")))
    values = lambda x: F.transform(F.array_sort(F.collect_list(x)), lambda p: p["a"])
    pair = lambda a: F.struct(F.col("frame").alias("frame"), a.alias("a"))
    whole, late = values(pair(F.round("activity", 8))), values(F.when(F.col("after_peak"), pair(F.round(F.col("activity") / 2, 10))))
    sets = rows.groupBy("region").agg(whole.alias("whole"), late.alias("late")).select("region", F.posexplode(F.array("whole", "late")).alias("curve", "values"))
    return curves.set_curves(sets, ["region"], rows.select("region", "t", "after_peak"), "t", "tissue")


@query(sql("boot") + """, p AS (SELECT region, avg(k1) AS k1, avg(k2) AS k2, avg(k3) AS k3 FROM boot GROUP BY region)
SELECT region AS name, round(k1 * k3 / (k2 + k3), 6) AS ki, printf('%s%s%s: ki = k1 * (k3 / (k2 + k3)) = %.2f * (%.2f / (%.2f + %.2f)) = %.2f', chr(39), region, chr(39), k1, k3, k2, k3, k1 * k3 / (k2 + k3)) AS text FROM p""")
def q_tissue_models(spark, d):
    """The two-tissue model of each region's mean rates."""
    means = proxies.rate_constants(spark, d).groupBy("region").agg(*[F.avg(c).alias(c) for c in ("k1", "k2", "k3")])
    made = means.select(kinetics.model(F.col("k1"), F.col("k2"), F.col("k3"), F.col("region")).alias("model"))
    return made.select("model.name", F.round("model.ki", 6).alias("ki"), "model.text")
