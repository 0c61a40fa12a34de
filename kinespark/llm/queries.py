"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespark.llm import exact_dedup, jaccard_join, language_id, license_scan, line_dedup, mixing, periodic_runs, quality_classifier, quality_rules, sentence_pieces, substring_dedup, token_counts, vector_codes
from kinespark.llm._common import table

#: Production parameters.
MIX_WEIGHTS = [3, 1, 2]
MIX_SHARE, MIX_MOST = 1.5, 2.0
TOKEN_LIMIT = 2048
TOKENIZER, PIECE_MODEL = "word_bpe_49k.json", "piece_bpe_32k.model"
LINE_MIN_DOCS, LINE_MIN_CHARS = 3, 20
PIECE_SEED = 17
SHINGLE_WORDS, SIMILARITY = 4, 85
SPAN_WORDS = 20
RUN_WORDS, RUN_TIMES = 24, 3
CODE_PARTS, CODE_ENTRIES, CODE_ROUNDS = 16, 64, 2


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(id_col: str = "doc_id"):
    """The fold that no training reads."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_SHARE, MIX_MOST)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = language_id.fit(docs, ~held_out())
    return language_id.predict(docs, net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_exact(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), SHINGLE_WORDS, SIMILARITY)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.dedup_lines(docs, LINE_MIN_DOCS, LINE_MIN_CHARS)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled pieces of each document, by number and hash, and whether decoding gives back the text."""
    path = tokenizer_path(PIECE_MODEL)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = sentence_pieces.encode(docs, path, PIECE_SEED, lossless_col="lossless")
    return encoded.select("doc_id", F.coalesce(F.size("pieces"), F.lit(0)).cast("long").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_hash"), "lossless")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), SPAN_WORDS)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = quality_rules.apply_rules(table(spark, sf_dir, "documents"))
    return cleaned.drop("clean_text")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    classifier = quality_classifier.fit(docs, labels)
    return quality_classifier.classify(docs, classifier, labels)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.with_token_counts(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER), TOKEN_LIMIT)


def with_periods(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text), where every tenth document (by a hash of its id) repeats some of its words with a period up to its end.

    With h the hash, g = h / 10 and n words, word i from a = g % n on becomes word a + (i - a) % p, p = 1 + (n - a) / (3 + g % 8).
    """
    found = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    chosen = (F.col("h") % 10 == 0) & (F.length(F.btrim("text", F.lit(" \t\n\v\f\r"))) > 0)
    words = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h")).select("doc_id", "text", F.when(chosen, found).alias("w"), F.floor(F.col("h") / 10).alias("g"))
    n, g = F.size("w"), F.col("g")
    placed = words.select("doc_id", "text", "w", "g", (g % n).cast("int").alias("a")).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    again = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("w", place(i))), " ")
    return placed.select("doc_id", F.when(F.col("w").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapse_runs(with_periods(table(spark, sf_dir, "documents")), RUN_WORDS, RUN_TIMES)
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.encode(F.array_join(F.transform("runs", line), ""), "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed_text", "UTF-8"), 256).alias("collapsed_sha256"),
    )


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"), CODE_PARTS, CODE_ENTRIES, CODE_ROUNDS)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_language_id, op3_exact_dedup, op4_jaccard_join, op5_line_dedup, op6_sentence_pieces, op7_substring_dedup, op8_quality_rules, op9_quality_classifier, op10_token_counts, op11_periodic_runs, op12_vector_codes, op13_license_scan)}

_WORDS = "len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))"
_LIST = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TOKENS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _quoted(text: str) -> str:
    return text.replace("'", "''")


#: One assignment of parts to entries, and the next entries; {} are the numbers of rounds.
_ASSIGNED = """a{0} AS (SELECT row, p, any_value(x) AS x, min(d * 64 + k) % 64 AS k, min(d) AS d
      FROM (SELECT row, x.p, x, k, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM x JOIN c{0} ON x.p = c{0}.p) GROUP BY row, p)"""
_MOVED = """m{1} AS (SELECT p, k, i, CAST(floor(sum(y) / count(*)) AS BIGINT) AS y FROM (SELECT p, k, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{0}) GROUP BY p, k, i),
c{1} AS (SELECT p, k, coalesce(m.c, c{0}.c) AS c FROM c{0} LEFT JOIN (SELECT p, k, list(y ORDER BY i) AS c FROM m{1} GROUP BY p, k) m USING (p, k))"""

ORACLES = {
    "op1_mix_sources": f"""
WITH d AS (SELECT doc_id, source, CAST({_WORDS} AS BIGINT) AS size, md5('mix-' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, 2e0 * source_size AS cap, [3, 1, 2][CAST(place % 3 + 1 AS INT)] AS weight FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (SELECT *, (1.5e0 * sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level FROM r
      WINDOW f AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT arg_min(level, place_in) AS chosen FROM (SELECT level, row_number() OVER (ORDER BY ratio, place) AS place_in FROM l WHERE level <= ratio)),
t AS (SELECT source, source_size, least(cap, coalesce(chosen * weight, cap)) AS target FROM l CROSS JOIN c),
p AS (SELECT doc_id, size, source_size, target, floor(target) AS goal,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(goal / source_size) ELSE 0 END AS rounds FROM p)
SELECT doc_id, size, source_size, target, CAST(rounds * size + greatest(0, least(size, goal - rounds * source_size - before)) AS BIGINT) AS taken FROM q""",
    "op3_exact_dedup": f"""
WITH d AS (SELECT doc_id, sha256({_LOWER.format("coalesce(text, '')")}) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256 FROM d""",
    "op5_line_dedup": f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
k AS (SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
c AS (SELECT key, max(doc_id) AS keep_id FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, c.keep_id IS NOT NULL AND c.keep_id <> k.doc_id AS lost FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE lost) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT lost), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
    "op4_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_LIST.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r(a, z) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, b.v FROM r JOIN b ON r.z = b.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(z) AS component_id FROM r GROUP BY a) m USING (doc_id)""",
    "op7_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_LIST.format("coalesce(text, '')")} AS w FROM documents),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
l AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS place FROM k) WHERE place > 1),
g AS (SELECT DISTINCT doc_id, i + j AS i FROM (SELECT doc_id, i, unnest(range(0, 20)) AS j FROM l)),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
o AS (SELECT x.doc_id, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY x.i) FILTER (WHERE g.i IS NULL) AS kept FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.i = g.i GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(o.n_removed, 0) AS n_removed, sha256(coalesce(o.kept, '')) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)""",
    "op8_quality_rules": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text, {_LIST.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT row, i, count(*) OVER (PARTITION BY row, w[i:i + 2]) AS times FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
h AS (SELECT row, count(DISTINCT i + j) AS n_repeat_words FROM (SELECT row, i, unnest([0, 1, 2]) AS j FROM g WHERE times > 1) GROUP BY row),
l AS (SELECT row, line, {_LIST.format("line")} AS v FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d)),
m AS (SELECT row, line, v, len(v) AS n, len(array_to_string(v, '')) AS size,
             len(regexp_extract_all(line, '[{quality_rules.SEPARATOR_CHARS}]')) + len(list_filter(v, lambda x: x IN {quality_rules.SEPARATOR_WORDS})) AS marks FROM l),
f AS (SELECT *, n > 0 AND (marks >= {quality_rules.SEPARATORS} AND marks * {quality_rules.WORDS_A_SEPARATOR} >= n
             OR n <= {quality_rules.BOILERPLATE_WORDS} AND regexp_matches(line, '(?i){quality_rules.BOILERPLATE.replace("'", "''")}')
             OR size >= 10 AND 10 * len(regexp_extract_all(line, '[^\\p{{L}}\\p{{N}}\\x20\\x09-\\x0D]')) > {10 * quality_rules.MOST_MARKS} * size
             OR n >= {quality_rules.LONG_LINE} AND NOT regexp_matches(line, '[{quality_rules.SENTENCE}]')) AS fails FROM m),
a AS (SELECT row, count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS n_dup_lines, count(*) FILTER (WHERE fails) AS n_lines_removed,
             CAST(coalesce(sum(n) FILTER (WHERE fails), 0) AS BIGINT) AS n_words_removed FROM f GROUP BY row),
o AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, n_lines_removed, n_words_removed FROM d JOIN a USING (row) LEFT JOIN h USING (row))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words_removed <= {quality_rules.MOST_LOST} * n_words AS kept FROM o""",
    "op11_periodic_runs": f"""
WITH d AS (SELECT doc_id, {_LIST.format("coalesce(text, '')")} AS w, xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
      lambda c, b: list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[], lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295::BIGINT)) AS h FROM documents),
n AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
a AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM n),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
t AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM p),
k AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + 16], ' ') AS key FROM (SELECT *, unnest(range(0, n - 15)) AS i FROM t)),
m AS (SELECT x.doc_id, y.i - x.i AS q, x.i AS i FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.key = y.key AND x.i < y.i AND 3 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + 15 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m) GROUP BY doc_id, q, island),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s WHERE length >= 24 AND length >= 3 * q GROUP BY doc_id, start, length),
b AS (SELECT doc_id, count(*) AS n_runs, first(struct_pack(start := start, length := length, period := period) ORDER BY length / period DESC, start, period) AS best,
             string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM r GROUP BY doc_id),
g AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, n)) AS i FROM t),
o AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) FILTER (WHERE g.i IS NULL) AS kept FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.i = g.i GROUP BY x.doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM t LEFT JOIN b USING (doc_id) LEFT JOIN o USING (doc_id)""",
    "op12_vector_codes": f"""
WITH v AS (SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT row, vec_id, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS x FROM v, range(16) AS parts(p)),
c0 AS (SELECT p, x AS c, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k FROM x WHERE row IN (SELECT row FROM v ORDER BY vec_id LIMIT 64)),
{_ASSIGNED.format(0)},
{_MOVED.format(0, 1)},
{_ASSIGNED.format(1)},
{_MOVED.format(1, 2)},
{_ASSIGNED.format(2)},
e AS (SELECT row, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY row)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) FROM c2) AS codebooks_sha256 FROM v JOIN e USING (row)""",
    "op13_license_scan": f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, {_TOKENS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
t AS (SELECT k, label, {_TOKENS.format(_LOWER.format("text"))} AS w FROM (VALUES {", ".join(f"({k}, '{label}', '{_quoted(text)}')" for k, (label, text) in enumerate((x, y) for x, ys in license_scan.TEMPLATES.items() for y in ys))}) AS v(k, label, text)),
tg AS (SELECT k, e, array_to_string(w[e:e + 3], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 2)) AS e FROM t)),
dg AS (SELECT row, i, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 2)) AS i FROM d)),
m AS (SELECT row, k, i, i - e AS diagonal, i - row_number() OVER (PARTITION BY row, k, i - e ORDER BY i) AS island FROM dg JOIN tg USING (g)),
g AS (SELECT row, k, diagonal, min(i) AS low, max(i) + 3 AS high FROM m GROUP BY row, k, diagonal, island),
e AS (SELECT row, k, diagonal, low, unnest(range(low + 3, high + 1)) AS last FROM g),
l AS (SELECT row, last, max(last - low + 1) AS size FROM e GROUP BY row, last),
x AS (SELECT e.row, e.k, e.low, e.last, e.last - e.diagonal AS place, l.size FROM e JOIN l ON l.row = e.row AND l.last = e.last LEFT JOIN l n ON n.row = e.row AND n.last = e.last + 1
      WHERE e.last - e.low + 1 = l.size AND coalesce(n.size, 0) <= l.size),
c AS (SELECT row, k, low, last, place, size, size AS weight FROM x
      UNION ALL SELECT b.row, b.k, b.low, b.last, b.place, b.size, a.weight + b.size - greatest(0, a.last + 1 - b.low, a.place - (b.place - b.size)) FROM c a JOIN x b
      ON a.row = b.row AND a.k = b.k AND a.low < b.low AND a.last <= b.last AND a.place < b.place AND a.place - a.size < b.place - b.size AND b.low - a.last - 1 <= {license_scan.GAP}),
s AS (SELECT row, label, max(weight) / any_value(len(w)) AS share FROM c JOIN t USING (k) GROUP BY row, k, label HAVING max(weight) >= {license_scan.LEAST_SHARE} * any_value(len(w))),
p AS (SELECT row, i - 1 AS place, label FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d) JOIN (VALUES {", ".join(f"('{phrase}', {len(phrase.split())}, '{label}')" for phrase, label in license_scan.PHRASES.items())}) AS v(phrase, n, label) ON array_to_string(w[i:i + n - 1], ' ') = phrase),
b AS (SELECT row, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY row),
a AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT row, label FROM p UNION ALL SELECT row, label FROM s) GROUP BY row),
h AS (SELECT row, max(share) AS share FROM s GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CAST(greatest(coalesce(share, 0), CASE WHEN n_base > 0 THEN {license_scan.PHRASE_SCORE} ELSE 0 END) AS DOUBLE) AS score FROM d LEFT JOIN b USING (row) LEFT JOIN a USING (row) LEFT JOIN h USING (row)""",
}
