"""The registered queries and, for each that SQL can express, the equivalent SQL. Each pair stands together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinespark.functions import curves
from kinespark.functions.quantiles import quantiles
from kinespark.operators import clusters, components, kinetics, lattice, tracer
from kinespark.plans import proxies
from kinespark.plans.proxies import sql
from kinespark.sources import tables
from kinespark.streaming import arrivals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return register


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def frame_time(frame):
    """Irregular mid-times in minutes."""
    return frame * frame / F.lit(64.0)


def _centroids(spark: SparkSession, d: str) -> DataFrame:
    return clusters.centroids(proxies.voxels(spark, d), proxies.labels(spark, d))


def _traits(spark: SparkSession, d: str) -> DataFrame:
    return clusters.traits(_centroids(spark, d))


TRAITS = sql("vox", "clu", "cent") + """,
size AS (SELECT k, label, count(*) AS voxel_count FROM clu GROUP BY k, label),
tr AS (SELECT k, label, arg_max(frame, activity) - 1 AS peak_index, max(activity) AS peak_value, bool_or(frame > 2 AND activity < 0) AS noise, arg_max(activity, frame) = max(activity) AS irreversible FROM cent GROUP BY k, label),
tt AS (SELECT *, voxel_count > sum(voxel_count) OVER (PARTITION BY k) / 5e0 AS background FROM tr JOIN size USING (k, label)),
t AS (SELECT *, NOT noise AND NOT irreversible AND NOT background AS vascular FROM tt),
b AS (SELECT * FROM t WHERE vascular QUALIFY row_number() OVER (PARTITION BY k ORDER BY peak_index, peak_value DESC, label) = 1)
"""


@query(TRAITS + """, e AS (SELECT * FROM b WHERE (peak_index + 1) * (peak_index + 1) / 64e0 < 10),
m AS (SELECT peak_index FROM e GROUP BY peak_index ORDER BY count(*) DESC, peak_index LIMIT 1)
SELECT k, label, peak_index, round(peak_value, 6) AS peak_value FROM e JOIN m USING (peak_index) ORDER BY e.peak_value DESC, k, label LIMIT 1""")
def q_best_overall(spark, d):
    best = clusters.best_in_k(_traits(spark, d))
    found = clusters.best_overall(best, frame_time(F.col("peak_index") + 1))
    return found.withColumn("peak_value", F.round("peak_value", 6))


@query(sql("vox", "clu") + "SELECT k, label, frame, round(avg(activity), 6) AS activity, count(*) AS voxel_count FROM vox JOIN clu USING (vox_id) GROUP BY k, label, frame")
def q_centroid_tac(spark, d):
    return _centroids(spark, d).withColumn("activity", F.round("activity", 6))


@query(TRAITS + "SELECT k, label, peak_index + 1 AS peak_index, round(peak_value, 6) AS peak_value FROM t")
def q_peak(spark, d):
    return curves.peak(_centroids(spark, d), ["k", "label"]).withColumn("peak_value", F.round("peak_value", 6))


@query(sql("vox", "clu", "cent") + ", p AS (SELECT k, label, arg_max(frame, activity) AS top FROM cent GROUP BY k, label) SELECT k, label, CAST(count(*) FILTER (WHERE frame < top) AS BIGINT) AS n_pre, CAST(count(*) FILTER (WHERE frame >= top) AS BIGINT) AS n_post, round(avg(activity) FILTER (WHERE frame >= top), 6) AS post_mean FROM cent JOIN p USING (k, label) GROUP BY k, label")
def q_pre_post_peak(spark, d):
    rows = curves.with_peak(_centroids(spark, d), ["k", "label"])
    return rows.groupBy("k", "label").agg(F.count_if(~F.col("after_peak")).alias("n_pre"), F.count_if("after_peak").alias("n_post"), r6(F.avg(F.when(F.col("after_peak"), F.col("activity"))), "post_mean"))


@query(TRAITS + "SELECT k, label, noise, irreversible, background, vascular FROM t")
def q_tac_predicates(spark, d):
    return _traits(spark, d).select("k", "label", "noise", "irreversible", "background", "vascular")


@query(sql("vox", "clu", "cent") + ", s AS (SELECT k, label, (activity + lag(activity) OVER w) / 2 * (frame * frame / 64e0 - lag(frame * frame / 64e0) OVER w) AS part FROM cent WINDOW w AS (PARTITION BY k, label ORDER BY frame)) SELECT k, label, round(sum(part), 6) AS auc FROM s GROUP BY k, label")
def q_auc(spark, d):
    rows = _centroids(spark, d).withColumn("t", frame_time(F.col("frame")))
    return curves.auc(rows, ["k", "label"]).withColumn("auc", F.round("auc", 6))


@query(sql("vox") + ", v AS (SELECT vox_id, frame, frame * frame / 64e0 AS t, activity FROM vox) SELECT vox_id, round(regr_slope(activity, t), 6) AS whole_slope, round(regr_intercept(activity, t), 6) AS whole_intercept, round(regr_slope(activity, t) FILTER (WHERE frame > 1), 6) AS wo_first_slope, round(regr_intercept(activity, t) FILTER (WHERE frame > 1), 6) AS wo_first_intercept FROM v GROUP BY vox_id")
def q_slope_intercept(spark, d):
    rows = proxies.voxels(spark, d).withColumn("t", frame_time(F.col("frame")))
    found = curves.lines(rows, ["vox_id"])
    return found.select("vox_id", *[F.round(c, 6).alias(c) for c in found.columns[1:]])


@query(sql("tac") + ", t AS (SELECT DISTINCT region, frame * frame / 64e0 AS t, frame % 7 <> 0 AS used FROM tac), w AS (SELECT *, least(t - lag(t, 1, 0e0) OVER o, lead(t, 1, 999999999.9e0) OVER o - t) AS duration FROM t WINDOW o AS (PARTITION BY region ORDER BY t)) SELECT region, round(t - duration / 2, 6) AS t_start, t AS t_mid, round(t + duration / 2, 6) AS t_end, round(duration, 6) AS duration, used, round(sqrt(duration), 6) AS weight, round(1 / sqrt(sqrt(duration)), 6) AS sigma FROM w")
def q_frame_timing(spark, d):
    times = proxies.regional_curves(spark, d).select("region", frame_time(F.col("frame")).alias("t"), (F.col("frame") % 7 != 0).alias("used")).distinct()
    found = curves.timing(times, ["region"])
    return found.select("region", *[F.round(c, 6).alias(c) if c in ("t_start", "t_end", "duration", "weight", "sigma") else c for c in found.columns[1:]])


@query(sql("pls") + ", s AS (SELECT curve_id, round((t - lag(t) OVER (PARTITION BY curve_id ORDER BY t)) * 10000) AS step FROM pls) SELECT curve_id, count(DISTINCT step) = 1 AS uniform FROM s GROUP BY curve_id")
def q_uniform_delta(spark, d):
    return curves.uniform(proxies.plasma(spark, d), ["curve_id"])


@query(sql("tac") + "SELECT frame, region, round(activity, 8) AS activity FROM tac")
def q_melt(spark, d):
    wide = q_pivot(spark, d)
    return curves.melt(wide, ["frame"], [c for c in wide.columns if c != "frame"]).where(F.col("activity").isNotNull())


REGIONS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(sql("tac") + "SELECT frame, " + ", ".join(f"round(max(activity) FILTER (WHERE region = '{r}'), 8) AS \"{r}\"" for r in REGIONS) + " FROM tac GROUP BY frame")
def q_pivot(spark, d):
    return proxies.regional_curves(spark, d).groupBy("frame").pivot("region", REGIONS).agg(F.round(F.max("activity"), 8))


@query(TRAITS + "SELECT k, label, cent.frame, round(activity, 6) AS activity, t.peak_index, t.vascular, b.k IS NOT NULL AS best_in_k FROM cent JOIN t USING (k, label) LEFT JOIN b USING (k, label)")
def q_plottable_long(spark, d):
    means, found = _centroids(spark, d), _traits(spark, d)
    rows = clusters.long_table(found, means, clusters.best_in_k(found))
    return rows.select("k", "label", "frame", F.round("activity", 6).alias("activity"), "peak_index", "vascular", "best_in_k")


@query(sql("tac") + "SELECT frame, region, round(activity, 8) AS activity FROM tac WHERE region IN ('1-URGENT', '5-LOW') AND frame <= 60 AND frame NOT IN (3, 7)")
def q_region_projection(spark, d):
    rows = proxies.regional_curves(spark, d)
    return rows.where(F.col("region").isin("1-URGENT", "5-LOW") & (F.col("frame") <= 60) & ~F.col("frame").isin(3, 7)).withColumn("activity", F.round("activity", 8))


@query(sql("tac") + "SELECT frame FROM (SELECT frame FROM tac WHERE frame % 3 = 0 UNION SELECT frame FROM tac WHERE frame % 5 = 0)")
def q_time_union(spark, d):
    rows = proxies.regional_curves(spark, d).select("frame")
    return rows.where("frame % 3 = 0").union(rows.where("frame % 5 = 0")).distinct()


@query(sql("vox") + "SELECT frame, round(avg(activity), 6) AS mean, round(stddev_pop(activity), 6) AS sd FROM vox WHERE vox_id IN (SELECT vec_id FROM embeddings WHERE label < 3) GROUP BY frame")
def q_mask_semi(spark, d):
    mask = proxies.lattice(spark, d).where("label < 3").select("vox_id")
    return proxies.voxels(spark, d).join(mask, "vox_id", "left_semi").groupBy("frame").agg(r6(F.avg("activity"), "mean"), r6(F.stddev_pop("activity"), "sd"))


@query(sql("vox") + "SELECT frame, round(avg(CASE WHEN region < 3 THEN activity ELSE 0e0 END), 6) AS mean FROM vox GROUP BY frame")
def q_mask_zero_fill(spark, d):
    mask = proxies.lattice(spark, d).where("label < 3").select("vox_id", F.lit(True).alias("inside"))
    rows = proxies.voxels(spark, d).join(mask, "vox_id", "left")
    return rows.groupBy("frame").agg(r6(F.avg(F.when(F.col("inside"), F.col("activity")).otherwise(0.0)), "mean"))


@query(sql("clu") + "SELECT k, label, CAST(CASE WHEN k = 10 THEN 2 * count(*) ELSE count(*) END AS BIGINT) AS n FROM clu GROUP BY k, label")
def q_upsert_centroids(spark, d):
    old = proxies.labels(spark, d).groupBy("k", "label").agg(F.count("*").alias("n"))
    return clusters.upsert(old, old.where("k = 10").withColumn("n", F.col("n") * 2), ["k", "label"])


@query("SELECT event_id, event_type AS unit, round(CASE event_type WHEN 'click' THEN value / 37e6 WHEN 'view' THEN value / 37e3 WHEN 'purchase' THEN value / 37e0 ELSE value END, 9) AS activity FROM events")
def q_units(spark, d):
    rows = proxies.read(spark, d, "events")
    unit = F.when(F.col("event_type") == "click", "Bq/mL").when(F.col("event_type") == "view", "kBq").when(F.col("event_type") == "purchase", "MBQ").otherwise("mCi")
    return rows.select("event_id", F.col("event_type").alias("unit"), F.round(curves.units_in_millicuries(F.col("value"), unit), 9).alias("activity"))


@query(sql("vox") + "SELECT vox_id, round(avg(activity), 6) AS mean FROM vox GROUP BY vox_id")
def q_mean_image(spark, d):
    # The curve is an array in its row: no shuffle.
    rows = proxies.read(spark, d, "embeddings")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") + F.lit(proxies.OFFSET))
    return rows.select(F.col("vec_id").alias("vox_id"), r6(total / F.size("embedding"), "mean"))


@query("SELECT label AS affine, n FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label) ORDER BY n DESC, label LIMIT 1")
def q_affine_mode(spark, d):
    return proxies.read(spark, d, "embeddings").groupBy(F.col("label").alias("affine")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "affine").limit(1)


@query(sql("vox", "xyz") + "SELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, frame, round(avg(activity), 6) AS activity FROM vox JOIN xyz USING (vox_id) GROUP BY 1, 2, 3, frame")
def q_downsample2(spark, d):
    cells = proxies.voxels(spark, d).join(proxies.lattice(spark, d), "vox_id")
    return lattice.block_means(cells, "activity", 2, ["frame"]).withColumn("activity", F.round("activity", 6))


@query(sql("xyz") + "SELECT vox_id, label, x, y, z - 2 AS z FROM xyz WHERE z >= 2")
def q_axial_clip(spark, d):
    return lattice.clip_axial(proxies.lattice(spark, d), 2)


DENSITY = sql("xyz", "clu") + ", den AS (SELECT k, clu.label, z, count(*) AS n FROM clu JOIN xyz USING (vox_id) GROUP BY ALL)"


def _density(spark, d):
    return lattice.density(proxies.labels(spark, d).join(proxies.lattice(spark, d).drop("label"), "vox_id"), ["k", "label"])


@query(DENSITY + "SELECT k, label, z, n FROM den")
def q_density(spark, d):
    return _density(spark, d)


#: The proxy image's slices: their thickness and the height of the first, in millimetres.
ZOOM, ORIGIN = 12.0, -110.0
CONFETTI = DENSITY + f""", tot AS (SELECT k, label, sum(n) AS total FROM den GROUP BY k, label),
com AS (SELECT sum(z * m) / sum(m) * {ZOOM}e0 + {ORIGIN}e0 AS mm FROM xyz JOIN (SELECT vec_id AS vox_id, list_avg(list_transform(embedding, lambda v: CAST(v AS DOUBLE) + 0.05e0)) AS m FROM embeddings) USING (vox_id)),
bnd AS (SELECT {", ".join(f"trunc((mm + {mm}e0 - {ORIGIN}e0) / {ZOOM}e0) AS {name}" for name, mm in (("lo", -33.6), ("hi", 84.0), ("weak", -31.9), ("strong", -67.7)))}, 10 AS floor FROM com),
cft AS (SELECT k, label, sum(n / total * (CASE WHEN z BETWEEN lo AND hi THEN -5e0 ELSE 0 END + CASE WHEN z < weak THEN 0.5e0 ELSE 0 END + CASE WHEN z < strong THEN 1e0 ELSE 0 END + CASE WHEN z < floor THEN 1e0 ELSE 0 END)) AS score FROM den JOIN tot USING (k, label) CROSS JOIN bnd GROUP BY k, label)
"""


def image_mass(spark, d):
    """(vox_id, mass): each voxel's mean activity, in its row."""
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") + F.lit(proxies.OFFSET))
    return proxies.read(spark, d, "embeddings").select(F.col("vec_id").alias("vox_id"), (total / F.size("embedding")).alias("mass"))


def image_center(spark, d):
    """One row: com_x, com_y, com_z of the mean image."""
    return lattice.center_of_mass(proxies.lattice(spark, d).join(image_mass(spark, d), "vox_id"), [], "mass")


def _confetti(spark, d):
    slices = _density(spark, d).withColumn("total", F.sum("n").over(Window.partitionBy("k", "label")))
    rows = slices.crossJoin(F.broadcast(image_center(spark, d).select(F.col("com_z").alias("image_z"))))  # one row
    return lattice.confetti(rows, ["k", "label"], "total", **lattice.confetti_bounds(F.col("image_z"), ZOOM, ORIGIN))


@query(CONFETTI + "SELECT k, label, round(score, 6) AS score, score > 0 AS likely_confetti FROM cft")
def q_confetti(spark, d):
    return _confetti(spark, d).withColumn("score", F.round("score", 6))


@query(sql("vox", "xyz") + "SELECT label, round(sum(x * m) / sum(m), 6) AS com_x, round(sum(y * m) / sum(m), 6) AS com_y, round(sum(z * m) / sum(m), 6) AS com_z FROM xyz JOIN (SELECT vox_id, sum(activity * activity) AS m FROM vox GROUP BY vox_id) USING (vox_id) GROUP BY label")
def q_center_of_mass(spark, d):
    mass = proxies.read(spark, d, "embeddings").select(F.col("vec_id").alias("vox_id"), F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.pow(x.cast("double") + F.lit(proxies.OFFSET), F.lit(2))).alias("mass"))
    found = lattice.center_of_mass(proxies.lattice(spark, d).join(mass, "vox_id"), ["label"], "mass")
    return found.select("label", *[F.round(f"com_{c}", 6).alias(f"com_{c}") for c in "xyz"])


BLOBS = """WITH RECURSIVE xyz AS (SELECT vec_id AS vox_id, label, vec_id % 8 AS x, (vec_id // 8) % 8 AS y, vec_id // 64 AS z FROM embeddings),
e AS (SELECT a.vox_id AS a, b.vox_id AS b FROM xyz a JOIN xyz b ON a.label = b.label AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1),
r AS (SELECT vox_id, vox_id AS root FROM xyz UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.vox_id WHERE r.root < e.b),
bl AS (SELECT xyz.label, xyz.vox_id, min(root) AS blob FROM xyz JOIN r USING (vox_id) GROUP BY ALL)
"""


def _blobs(spark, d):
    return lattice.blobs(proxies.lattice(spark, d), ["label"])


@query(BLOBS + "SELECT label, vox_id, blob FROM bl")
def q_blobs(spark, d):
    return _blobs(spark, d).select("label", "vox_id", "blob")


@query(BLOBS + "SELECT label, blob, count(*) AS n FROM bl GROUP BY ALL")
def q_blob_stats(spark, d):
    return lattice.blob_sizes(_blobs(spark, d), ["label"])


SPARSE = BLOBS + ", s AS (SELECT label, blob, count(*) AS n FROM bl GROUP BY ALL), p AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY label ORDER BY n DESC, blob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER (PARTITION BY label) AS prev_share FROM s)"


@query(SPARSE + "SELECT label, CAST(count(*) FILTER (WHERE prev_share <= 0.95e0) AS BIGINT) AS sparsity, count(*) AS blob_count FROM p GROUP BY label")
def q_sparsity(spark, d):
    return lattice.sparsity(lattice.blob_sizes(_blobs(spark, d), ["label"]), ["label"]).groupBy("label").agg(F.count_if("kept").alias("sparsity"), F.count("*").alias("blob_count"))


@query(SPARSE + "SELECT label, vox_id FROM bl JOIN p USING (label, blob) WHERE prev_share <= 0.8e0")
def q_sparsity_reduce(spark, d):
    found = _blobs(spark, d)
    kept = lattice.sparsity(lattice.blob_sizes(found, ["label"]), ["label"], 0.8).where("kept")
    return found.join(kept.select("label", "blob"), ["label", "blob"], "left_semi").select("label", "vox_id")


DICE = sql("clu") + ", sz AS (SELECT k, label, count(*) AS n FROM clu GROUP BY k, label), di AS (SELECT a.k AS k1, a.label AS label1, b.k AS k2, b.label AS label2, count(*) AS shared FROM clu a JOIN clu b USING (vox_id) GROUP BY ALL), dice AS (SELECT k1, label1, k2, label2, 2e0 * shared / (x.n + y.n) AS dice FROM di JOIN sz x ON x.k = k1 AND x.label = label1 JOIN sz y ON y.k = k2 AND y.label = label2)"


@query(DICE + "SELECT k1, label1, k2, label2, round(dice, 6) AS dice FROM dice")
def q_dice(spark, d):
    return clusters.dice(proxies.labels(spark, d)).withColumn("dice", F.round("dice", 6))


ALL_CLUSTERS = [(k, label) for k in proxies.KS for label in range(1, k + 1)]


@query(DICE + "SELECT k1, label1, " + ", ".join(f"round(coalesce(max(dice) FILTER (WHERE k2 = {k} AND label2 = {i}), 0), 6) AS \"c{i:02d}_{k:02d}\"" for k, i in ALL_CLUSTERS) + " FROM dice GROUP BY k1, label1")
def q_dice_matrix(spark, d):
    name = F.format_string("c%02d_%02d", "label2", "k2")
    rows = clusters.dice(proxies.labels(spark, d)).withColumn("name", name)
    return rows.groupBy("k1", "label1").pivot("name", [f"c{i:02d}_{k:02d}" for k, i in ALL_CLUSTERS]).agg(F.round(F.max("dice"), 6)).fillna(0.0)


@query("WITH v AS (SELECT label, unnest(range(1, 65)) AS f, CAST(unnest(embedding) AS DOUBLE) AS a FROM embeddings), m AS (SELECT label, f, avg(a) AS a FROM v GROUP BY label, f) SELECT x.label AS label1, y.label AS label2, round(sum(x.a * y.a) / (sqrt(sum(x.a * x.a)) * sqrt(sum(y.a * y.a))), 6) AS cosine FROM m x JOIN m y ON x.f = y.f AND x.label < y.label GROUP BY ALL")
def q_cosine(spark, d):
    rows = proxies.read(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("f", "a")).groupBy("label", "f").agg(F.avg(F.col("a").cast("double")).alias("a"))
    x, y = (rows.select(F.col("label").alias(f"label{i}"), "f", F.col("a").alias(f"a{i}")) for i in (1, 2))
    both = x.join(y, "f").where("label1 < label2").groupBy("label1", "label2")
    return both.agg(r6(F.sum(F.col("a1") * F.col("a2")) / (F.sqrt(F.sum(F.col("a1") * F.col("a1"))) * F.sqrt(F.sum(F.col("a2") * F.col("a2")))), "cosine"))


@query(DICE + ", m AS (SELECT k1, label1, k2, max(dice) AS best, CAST(count(*) FILTER (WHERE dice > 0.5e0) AS BIGINT) AS ov FROM dice WHERE k1 <> k2 GROUP BY ALL) SELECT k1 AS k, label1 AS label, round(avg(best), 6) AS stability, CAST(sum(ov) AS BIGINT) AS overlapping FROM m GROUP BY ALL")
def q_k_stability(spark, d):
    found = clusters.stability(clusters.dice(proxies.labels(spark, d)))
    return found.select(F.col("k1").alias("k"), F.col("label1").alias("label"), r6(F.col("stability"), "stability"), F.col("overlapping").cast("long").alias("overlapping"))


#: Blobs of all clusters of all ks, as common table expressions that follow others.
CLUSTER_BLOBS = """, xyz AS (SELECT vec_id AS vox_id, vec_id % 8 AS x, (vec_id // 8) % 8 AS y, vec_id // 64 AS z FROM embeddings),
ce AS (SELECT clu.k, clu.label, clu.vox_id, x, y, z FROM clu JOIN xyz USING (vox_id)),
ed AS (SELECT a.k, a.label, a.vox_id AS a, b.vox_id AS b FROM ce a JOIN ce b ON a.k = b.k AND a.label = b.label AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1),
rr AS (SELECT k, label, vox_id, vox_id AS root FROM ce UNION SELECT ed.k, ed.label, ed.b, rr.root FROM rr JOIN ed ON ed.k = rr.k AND ed.label = rr.label AND ed.a = rr.vox_id WHERE rr.root < ed.b),
cb AS (SELECT k, label, vox_id, min(root) AS blob FROM rr GROUP BY ALL),
bs AS (SELECT k, label, blob, count(*) AS n FROM cb GROUP BY ALL),
bc AS (SELECT k, label, count(*) AS blobs FROM bs GROUP BY ALL)
"""
RECURSIVE_TRAITS = TRAITS.replace("WITH ", "WITH RECURSIVE ", 1) + CLUSTER_BLOBS
#: Samples after the best's peak that an alternate may peak at: one is the rule, but these curves rarely have such.
WITHIN = 64


def cluster_blobs(spark, d):
    cells = proxies.labels(spark, d).join(proxies.lattice(spark, d).drop("label"), "vox_id")
    return lattice.blobs(cells, ["k", "label"])


@query(RECURSIVE_TRAITS + """, near AS (SELECT t.k, t.label, t.peak_index, t.peak_value, b.label AS best FROM t JOIN b ON t.k = b.k AND t.peak_index > b.peak_index AND t.peak_value > b.peak_value WHERE t.vascular
    QUALIFY row_number() OVER (PARTITION BY t.k ORDER BY t.peak_value DESC, t.label) = 1)
SELECT near.k, near.label, near.peak_index, round(near.peak_value, 6) AS peak_value FROM near JOIN bc x ON x.k = near.k AND x.label = near.label JOIN bc y ON y.k = near.k AND y.label = near.best WHERE x.blobs < y.blobs""")
def q_alternate(spark, d):
    found = _traits(spark, d)
    sizes = lattice.blob_sizes(cluster_blobs(spark, d), ["k", "label"])
    return clusters.alternates(found, clusters.best_in_k(found), sizes, WITHIN).withColumn("peak_value", F.round("peak_value", 6))


@query(sql("clu") + "SELECT vox_id, " + ", ".join(f"CAST(max(CASE WHEN label = {i} THEN 1 ELSE 0 END) AS INT) AS m{i}" for i in range(1, 7)) + " FROM clu WHERE k = 6 GROUP BY vox_id")
def q_onehot(spark, d):
    rows = proxies.labels(spark, d, (6,))
    return rows.select("vox_id", *[F.when(F.col("label") == i, 1).otherwise(0).alias(f"m{i}") for i in range(1, 7)])


@query(sql("vox") + ", s AS (SELECT region, frame, avg(activity) AS m, stddev_pop(activity) AS sd FROM vox GROUP BY ALL) SELECT region, vox_id FROM vox JOIN s USING (region, frame) GROUP BY region, vox_id HAVING bool_and(abs(activity - m) <= 2.5e0 * sd)")
def q_winsor(spark, d):
    return curves.winsorized(proxies.voxels(spark, d), ["vox_id"], ["region"], width=2.5)


@query(sql("vox") + ", p AS (SELECT frame, quantile_cont(activity, 0.95) AS p95 FROM vox GROUP BY frame) SELECT frame, CAST(count(*) FILTER (WHERE activity > p95) AS BIGINT) AS n_over, round(max(p95), 6) AS p95 FROM vox JOIN p USING (frame) GROUP BY frame")
def q_percentile_mask(spark, d):
    rows = proxies.voxels(spark, d)
    top = quantiles(rows, ["frame"], "activity", 0.95).withColumnRenamed("activity", "p95")
    return rows.join(top, "frame").groupBy("frame").agg(F.count_if(F.col("activity") > F.col("p95")).alias("n_over"), r6(F.max("p95"), "p95"))


@query(sql("vox") + ", s AS (SELECT vox_id, region, avg(activity) AS mean FROM vox GROUP BY ALL), z AS (SELECT region, avg(mean) AS m, stddev_pop(mean) AS sd FROM s GROUP BY region) SELECT region, frame, round(avg(activity), 6) AS activity FROM vox JOIN s USING (vox_id, region) JOIN z USING (region) WHERE mean > m + sd GROUP BY region, frame")
def q_sd_mask_tacs(spark, d):
    rows = proxies.voxels(spark, d)
    means = rows.groupBy("vox_id", "region").agg(F.avg("activity").alias("mean"))
    bounds = means.groupBy("region").agg((F.avg("mean") + F.stddev_pop("mean")).alias("least"))
    mask = means.join(bounds, "region").where("mean > least").select("vox_id")
    return rows.join(mask, "vox_id", "left_semi").groupBy("region", "frame").agg(r6(F.avg("activity"), "activity"))


@query(sql("xyz") + ", s AS (SELECT label, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM xyz GROUP BY label) SELECT label, round(avg(CASE WHEN sqrt(0e0 + pow(x - mx, 2) + pow(y - my, 2) + pow(z - mz, 2)) <= 2 * pow(3 * n / (4 * pi()), 1e0 / 3) THEN 1e0 ELSE 0e0 END), 6) AS ratio FROM xyz JOIN s USING (label) GROUP BY label")
def q_sphere(spark, d):
    return lattice.sphere_ratio(proxies.lattice(spark, d), ["label"]).withColumn("ratio", F.round("ratio", 6))


@query(sql("boot") + "SELECT curve_id, region, round(k1 * k3 / (k2 + k3), 6) AS ki FROM boot")
def q_ki(spark, d):
    rows = proxies.rate_constants(spark, d)
    return rows.select("curve_id", "region", r6(kinetics.ki(F.col("k1"), F.col("k2"), F.col("k3")), "ki"))


@query(sql("boot") + "SELECT region, round(avg(k1), 6) AS k1, round(avg(k2), 6) AS k2, round(avg(k3), 6) AS k3, round(avg(k1 * k3 / (k2 + k3)), 6) AS ki FROM boot GROUP BY region")
def q_ki_mean(spark, d):
    rows = proxies.rate_constants(spark, d).withColumn("ki", kinetics.ki(F.col("k1"), F.col("k2"), F.col("k3")))
    return rows.groupBy("region").agg(*[r6(F.avg(c), c) for c in ("k1", "k2", "k3", "ki")])


@query(sql("boot") + ", c AS (SELECT region, CASE WHEN least(k1, k2, k3) < 1e-4 THEN 41 WHEN least(abs(1 - k1), abs(1 - k2), abs(1 - k3)) < 1e-4 THEN 42 ELSE 0 END AS code FROM boot) SELECT region, code, count(*) AS n FROM c GROUP BY ALL")
def q_rate_validity(spark, d):
    code = kinetics.validity(F.col("k1"), F.col("k2"), F.col("k3"))
    return proxies.rate_constants(spark, d).groupBy("region", code.alias("code")).agg(F.count("*").alias("n"))


def _kde(value: str) -> str:
    return sql("boot") + f""", c AS (SELECT region, {value} AS v, count(*) AS w FROM boot GROUP BY ALL),
s AS (SELECT region, sum(w) AS n, min(v) AS low, max(v) AS high, sqrt((sum(w * v * v) - sum(w * v) * sum(w * v) / sum(w)) / (sum(w) - 1)) * pow(sum(w), -0.2e0) AS h FROM c GROUP BY region),
g AS (SELECT *, low + i * (high - low) / 999 AS x FROM s CROSS JOIN (SELECT unnest(range(0, 1000)) AS i)),
dn AS (SELECT g.region, i, x, sum(w * exp(-((x - v) / h) * ((x - v) / h) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS density FROM g JOIN c USING (region) GROUP BY g.region, i, x),
t AS (SELECT *, max(density) OVER (PARTITION BY region) AS top FROM dn)
"""


@query(_kde("k2") + "SELECT region, round(min(x) FILTER (WHERE density > top / 2), 4) AS \"left\", round(max(x) FILTER (WHERE density > top / 2), 4) AS \"right\", round(max(top), 6) AS max_density FROM t GROUP BY region")
def q_kde_fwhm(spark, d):
    found = kinetics.kde_fwhm(proxies.rate_constants(spark, d), ["region"], "k2")
    return found.select("region", F.round("left", 4).alias("left"), F.round("right", 4).alias("right"), r6(F.col("max_density"), "max_density"))


BOUNDED = {"k1": "k1", "k2": "k2", "k3": "k3", "ki": "k1 * k3 / (k2 + k3)"}
_KDE_ALL = _kde("k3").replace("c AS (SELECT region, k3 AS v, count(*) AS w FROM boot GROUP BY ALL)", "c AS (SELECT l.region || '/' || p AS region, v, count(*) AS w FROM (" + " UNION ALL ".join(f"SELECT region, '{n}' AS p, {e} AS v FROM boot" for n, e in BOUNDED.items()) + ") l GROUP BY ALL)")


@query(_KDE_ALL + "SELECT split_part(region, '/', 1) AS region, split_part(region, '/', 2) AS param, round(min(x) FILTER (WHERE density > top / 2), 4) AS low, round(max(x) FILTER (WHERE density > top / 2), 4) AS high FROM t GROUP BY ALL")
def q_bounds(spark, d):
    rows = proxies.rate_constants(spark, d)
    each = [rows.select("region", F.lit(n).alias("param"), F.expr(e).alias("value")) for n, e in BOUNDED.items()]
    rows = each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])
    return kinetics.kde_fwhm(rows, ["region", "param"], "value").select("region", "param", F.round("left", 4).alias("low"), F.round("right", 4).alias("high"))


@query(sql("tac") + ", f AS (SELECT frame, activity AS fit FROM tac WHERE region = '1-URGENT') SELECT frame, region, round((activity - 0.05e0 * fit) / (1 - 0.05e0), 8) AS corrected, round(((activity - 0.05e0 * fit) / (1 - 0.05e0) - 0.05e0 * fit) / (1 - 0.05e0), 8) AS twice FROM tac JOIN f USING (frame)")
def q_vascular_corr(spark, d):
    rows = proxies.regional_curves(spark, d)
    fit = rows.where("region = '1-URGENT'").select("frame", F.col("activity").alias("fit"))
    correct = lambda twice: kinetics.vascular_correction(F.col("activity"), F.col("fit"), 5.0, twice)
    return rows.join(fit, "frame").select("frame", "region", F.round(correct(False), 8).alias("corrected"), F.round(correct(True), 8).alias("twice"))


@query(sql("tac") + "SELECT region, row_number() OVER (PARTITION BY region ORDER BY frame) AS frame, round(activity, 8) AS activity FROM (SELECT frame, region, activity FROM tac UNION ALL SELECT 0, region, 0e0 FROM (SELECT DISTINCT region FROM tac))")
def q_zero_pad(spark, d):
    rows = proxies.regional_curves(spark, d)
    zero = rows.select(F.lit(0).cast("long").alias("frame"), "region", F.lit(0.0).alias("activity")).distinct()
    return rows.unionByName(zero).select("region", F.row_number().over(Window.partitionBy("region").orderBy("frame")).cast("long").alias("frame"), F.round("activity", 8).alias("activity"))


@query(sql("pls") + """, kn AS (SELECT curve_id, t, avg(activity) AS y FROM pls GROUP BY ALL),
gr AS (SELECT curve_id, unnest(range(0, 61)) * 720e0 AS t FROM (SELECT DISTINCT curve_id FROM pls)),
nx AS (SELECT *, lead(t) OVER w AS tn, lead(y) OVER w AS yn FROM kn WINDOW w AS (PARTITION BY curve_id ORDER BY t)),
fr AS (SELECT curve_id, arg_min(y, t) AS y0 FROM kn GROUP BY curve_id)
SELECT gr.curve_id, gr.t, round(coalesce(CASE WHEN nx.tn IS NULL THEN nx.y ELSE nx.y + (gr.t - nx.t) * (nx.yn - nx.y) / (nx.tn - nx.t) END, y0), 6) AS activity
FROM gr ASOF LEFT JOIN nx ON gr.curve_id = nx.curve_id AND gr.t >= nx.t JOIN fr ON fr.curve_id = gr.curve_id""")
def q_interp_linear(spark, d):
    rows = proxies.plasma(spark, d)
    grid = rows.select("curve_id").distinct().select("curve_id", F.explode(F.sequence(F.lit(0), F.lit(60))).alias("i")).select("curve_id", (F.col("i") * F.lit(720.0)).alias("t"))
    return curves.interpolate(rows, grid, ["curve_id"]).withColumn("activity", F.round("activity", 6))


@query(sql("vox", "clu", "cent") + """, a AS (SELECT k, label, frame * frame / 64e0 AS t, activity AS y FROM cent),
b AS (SELECT *, lead(t) OVER w - t AS h, (lead(y) OVER w - y) / (lead(t) OVER w - t) AS m, lead(y) OVER w AS y1 FROM a WINDOW w AS (PARTITION BY k, label ORDER BY t)),
c AS (SELECT *, lag(h) OVER w AS h0, lag(m) OVER w AS m0, lead(h) OVER w AS h1, lead(m) OVER w AS m1, lag(h, 2) OVER w AS h00, lag(m, 2) OVER w AS m00 FROM b WINDOW w AS (PARTITION BY k, label ORDER BY t)),
e AS (SELECT *, ((2 * h + h1) * m - h * m1) / (h + h1) AS head, ((2 * h0 + h00) * m0 - h0 * m00) / (h0 + h00) AS tail FROM c),
s AS (SELECT *, CASE
  WHEN m0 IS NULL THEN CASE WHEN h1 IS NULL THEN m WHEN sign(head) <> sign(m) THEN 0 WHEN sign(m) <> sign(m1) AND abs(head) > 3 * abs(m) THEN 3 * m ELSE head END
  WHEN m IS NULL THEN CASE WHEN h00 IS NULL THEN m0 WHEN sign(tail) <> sign(m0) THEN 0 WHEN sign(m0) <> sign(m00) AND abs(tail) > 3 * abs(m0) THEN 3 * m0 ELSE tail END
  WHEN m0 * m <= 0 THEN 0 ELSE (3 * h + 3 * h0) / ((2 * h + h0) / m0 + (h + 2 * h0) / m) END AS d FROM e),
f AS (SELECT *, lead(d) OVER (PARTITION BY k, label ORDER BY t) AS d1 FROM s),
g AS (SELECT *, unnest(CASE WHEN h IS NULL THEN [0e0] ELSE [0e0, 0.5e0] END) AS u FROM f)
SELECT k, label, t + u * coalesce(h, 0) AS t, round(CASE WHEN u = 0 THEN y ELSE (2 * u * u * u - 3 * u * u + 1) * y + (u * u * u - 2 * u * u + u) * h * d + (3 * u * u - 2 * u * u * u) * y1 + (u * u * u - u * u) * h * d1 END, 6) AS activity FROM g""")
def q_pchip(spark, d):
    rows = _centroids(spark, d).withColumn("t", frame_time(F.col("frame"))).select("k", "label", "t", "activity")
    return curves.pchip(rows, ["k", "label"]).withColumn("activity", F.round("activity", 6))


@query(sql("tac") + "SELECT a.region, a.frame, round(sum(exp(-0.1e0 * (a.frame - b.frame)) * b.activity) * 1e0, 6) AS activity FROM tac a JOIN tac b ON a.region = b.region AND b.frame <= a.frame GROUP BY ALL")
def q_convolve(spark, d):
    return curves.convolve(proxies.regional_curves(spark, d), lambda lag: F.exp(F.lit(-0.1) * lag), ["region"]).withColumn("activity", F.round("activity", 6))


@query(sql("tac", "boot") + ", p AS (SELECT region AS flag, avg(k1) AS k1, avg(k2) AS k2, avg(k3) AS k3 FROM boot GROUP BY 1) SELECT flag, a.region, a.frame, round(sum(k1 / (k2 + k3) * (k3 + k2 * exp(-(k2 + k3) * (a.frame - b.frame))) * b.activity), 6) AS activity FROM tac a JOIN tac b ON a.region = b.region AND b.frame <= a.frame CROSS JOIN p GROUP BY ALL")
def q_2tc_curve(spark, d):
    rates = proxies.rate_constants(spark, d).groupBy(F.col("region").alias("flag")).agg(*[F.avg(c).alias(c) for c in ("k1", "k2", "k3")])
    rows = proxies.regional_curves(spark, d).crossJoin(F.broadcast(rates))  # a few rows a region
    kernel = lambda lag: kinetics.impulse_response(F.col("rates.k1"), F.col("rates.k2"), F.col("rates.k3"), lag)
    rows = rows.select("flag", "region", "frame", "activity", F.struct("k1", "k2", "k3").alias("rates"))
    return curves.convolve(rows, kernel, ["flag", "region", "rates"]).select("flag", "region", "frame", r6(F.col("activity"), "activity"))


_M = "((-0.018e0 + 0.0135e0) / (-0.27e0 + 0.2e0))"
_ZETA = f"(-0.05e0 - {_M}) * exp(-0.2e0 * (a.frame - b.frame)) + {_M} * exp(-0.27e0 * (a.frame - b.frame))"


@query(sql("tac") + f", s AS (SELECT frame, activity FROM tac WHERE region = '1-URGENT'), m AS (SELECT a.frame, sum(({_ZETA}) * b.activity) + any_value(a.activity) AS model FROM s a JOIN s b ON b.frame <= a.frame GROUP BY a.frame) SELECT region, round(sum((activity - model) * (activity - model)), 4) AS cost FROM tac JOIN m USING (frame) WHERE region <> '1-URGENT' GROUP BY region")
def q_s2t_cost(spark, d):
    rows = proxies.regional_curves(spark, d)
    source = rows.where("region = '1-URGENT'")
    kernel = lambda lag: kinetics.zeta((0.1, 0.2), (0.15, 0.12), lag)
    model = curves.convolve(source, kernel, ["region"]).join(source.select("frame", F.col("activity").alias("own")), "frame").select("frame", (F.col("activity") + F.col("own")).alias("model"))
    return rows.where("region <> '1-URGENT'").join(model, "frame").groupBy("region").agg(F.round(F.sum(F.pow(F.col("activity") - F.col("model"), 2)), 4).alias("cost"))


@query(sql("vox") + ", f AS (SELECT *, 0.08e0 * exp(-0.05e0 * frame * frame / 64e0) AS f1, 0.02e0 + 0.06e0 * exp(-0.5e0 * frame * frame / 64e0) AS f2 FROM vox), r AS (SELECT vox_id, sqrt(sum((activity - f1) * (activity - f1))) AS r1, sqrt(sum((activity - f2) * (activity - f2))) AS r2 FROM f GROUP BY vox_id) SELECT vox_id, CASE WHEN r1 <= r2 THEN 1 ELSE 2 END AS best, round(least(r1, r2), 6) AS rms FROM r")
def q_decay_eval(spark, d):
    t = frame_time(F.col("frame"))
    rows = proxies.voxels(spark, d).withColumn("f1", curves.decay(t, [(0.08, 0.05)])).withColumn("f2", curves.decay(t, [(0.02, 0.0), (0.06, 0.5)]))
    off = lambda c: F.sqrt(F.sum(F.pow(F.col("activity") - F.col(c), 2)))
    found = rows.groupBy("vox_id").agg(off("f1").alias("r1"), off("f2").alias("r2"))
    return found.select("vox_id", F.when(F.col("r1") <= F.col("r2"), 1).otherwise(2).alias("best"), r6(F.least("r1", "r2"), "rms"))


@query("SELECT user_id, event_type AS failure, count(*) AS n FROM events GROUP BY ALL")
def q_failures(spark, d):
    return proxies.read(spark, d, "events").groupBy("user_id", F.col("event_type").alias("failure")).agg(F.count("*").alias("n"))


@query("SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)/?(.*)$', 1) AS scheme, regexp_extract(url, '^(https?)://([^/]+)/?(.*)$', 2) AS host, CAST(len(regexp_extract(url, '^(https?)://([^/]+)/?(.*)$', 3)) AS INT) AS path_chars FROM pages WHERE regexp_matches(url, '^(https?)://([^/]+)/?(.*)$')")
def q_log_regex(spark, d):
    found = tables.log_values(proxies.read(spark, d, "pages"), r"^(https?)://([^/]+)/?(.*)$", {"scheme": (1, "string"), "host": (2, "string"), "path": (3, "string")}, "url")
    return found.select("page_id", "scheme", "host", F.length("path").alias("path_chars"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def q_json_sidecar(spark, d):
    return proxies.read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")).where("k IS NOT NULL")


@query(sql("clu", "xyz") + "SELECT 'run-a' AS run, 0 AS clipped, k, label, count(*) AS n FROM clu GROUP BY ALL UNION ALL SELECT 'run-b', 2, k, clu.label, count(*) FROM clu JOIN xyz USING (vox_id) WHERE z >= 2 GROUP BY ALL")
def q_runs_union(spark, d):
    def one(run: str, clipped: int) -> DataFrame:
        cells = proxies.labels(spark, d).join(lattice.clip_axial(proxies.lattice(spark, d).drop("label"), clipped), "vox_id")
        return cells.groupBy("k", "label").agg(F.count("*").alias("n")).select(F.lit(run).alias("run"), F.lit(clipped).alias("clipped"), "k", "label", "n")

    return one("run-a", 0).unionByName(one("run-b", 2), allowMissingColumns=True)


@query("SELECT l_returnflag AS region, round(avg(l_extendedprice), 2) AS mean, round(stddev_pop(l_extendedprice), 4) AS sd, round(min(l_extendedprice), 2) AS low, round(max(l_extendedprice), 2) AS high FROM lineitem GROUP BY 1")
def q_stat_str(spark, d):
    v = F.col("l_extendedprice")
    return proxies.read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("region")).agg(F.round(F.avg(v), 2).alias("mean"), F.round(F.stddev_pop(v), 4).alias("sd"), F.round(F.min(v), 2).alias("low"), F.round(F.max(v), 2).alias("high"))


@query("SELECT l_returnflag AS region, CAST(floor(l_quantity / 5e0) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY ALL")
def q_histogram(spark, d):
    return proxies.read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("region"), F.floor(F.col("l_quantity") / F.lit(5.0)).alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, round(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) - value, 6) AS delta FROM events")
def q_progress_delta(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return proxies.read(spark, d, "events").select("event_id", "user_id", r6(F.lag("value").over(w) - F.col("value"), "delta"))


#: Cluster counts of the k-means sweep, those of the reference.
SWEEP_KS = tuple(range(6, 39, 4))
#: Frames of each curve.
FRAMES = 64


def _points(spark, d, dims: int | None = None) -> DataFrame:
    rows = proxies.read(spark, d, "embeddings")
    point = F.transform("embedding", lambda x: x.cast("double") + F.lit(proxies.OFFSET))
    return rows.select(F.col("vec_id").alias("vox_id"), (F.slice(point, 1, dims) if dims else point).alias("point"))


@query("""WITH p AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE) + 0.05e0) AS v FROM embeddings),
c0 AS (SELECT vec_id + 1 AS label, v AS c FROM p WHERE vec_id < 4),
n1 AS (SELECT vec_id, arg_min(label, (round(list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - c.c[i]) * (p.v[i] - c.c[i]))), 9), label)) AS label FROM p, c0 c GROUP BY vec_id),
e1 AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, unnest(range(1, 65)) AS i FROM n1 JOIN p USING (vec_id)) GROUP BY label, i),
c1 AS (SELECT label, list(x ORDER BY i) AS c FROM e1 GROUP BY label),
n2 AS (SELECT vec_id, arg_min(label, (round(list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - c.c[i]) * (p.v[i] - c.c[i]))), 9), label)) AS label FROM p, c1 c GROUP BY vec_id),
z AS (SELECT label, count(*) AS n FROM n2 GROUP BY label)
SELECT label, i AS frame, round(avg(x), 6) AS activity, any_value(z.n) AS n FROM (SELECT label, unnest(v) AS x, unnest(range(1, 65)) AS i FROM n2 JOIN p USING (vec_id)) JOIN z USING (label) GROUP BY label, i""")
def q_kmeans_lloyd(spark, d):
    points = _points(spark, d)
    centers = [r["point"] for r in points.where("vox_id < 4").orderBy("vox_id").collect()]  # four rows
    for _ in range(2):
        found = clusters.kmeans_step(points, centers)
        centers = [r["center"] for r in found.orderBy("label").collect()]  # k rows
    return found.select("label", F.posexplode("center").alias("at", "x"), "n").select("label", (F.col("at") + 1).cast("long").alias("frame"), r6(F.col("x"), "activity"), "n")


@query()
def q_kmeans_mllib(spark, d):
    return components.kmeans_sweep(_points(spark, d), SWEEP_KS)


@query()
def q_pca(spark, d):
    return components.principal(_points(spark, d), FRAMES).withColumn("score", F.round("score", 6))


@query()
def q_ica(spark, d):
    # As many components as tell most, and all that centred curves have.
    points = _points(spark, d)
    found = [components.independent(points, FRAMES, n).select(F.lit(n).alias("n"), "vox_id", "component", "score") for n in (6, FRAMES - 1)]
    return found[0].unionByName(found[1]).withColumn("score", F.round("score", 6))


@query()
def q_curve_fit(spark, d):
    # All clusters of all ks; the id of each one's curve is 1000 k + label. Errors weigh by the frames' lengths.
    rows = curves.with_peak(_centroids(spark, d), ["k", "label"]).where("after_peak").withColumn("t", frame_time(F.col("frame")))
    sigma = 1 / F.sqrt(F.sqrt((2 * F.col("frame") + 1) / F.lit(64.0)))
    fits = tracer.best_fits(tracer.fit_decays(rows.select((F.col("k") * 1000 + F.col("label")).cast("long").alias("curve_id"), "t", "activity", sigma.alias("sigma"))))
    return fits.select(F.floor(F.col("curve_id") / 1000).alias("k"), (F.col("curve_id") % 1000).alias("label"), *fits.columns)


@query("SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS start, max(value) AS peak_value, count(*) AS n FROM events GROUP BY ALL")
def q_running_peaks(spark, d):
    rows = proxies.read(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("activity"))
    return arrivals.running_peaks(rows, ["user_id"]).withColumn("start", F.col("start").cast("timestamp_ntz"))
