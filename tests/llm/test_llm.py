"""The corpus operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinespark.llm import exact_dedup, jaccard_join, language_id, line_dedup, mixing, queries, quality_classifier, quality_rules, sentence_pieces, substring_dedup, token_counts, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_sha256 string, key string, id string"
PASSAGE = " ".join(f"pass{i}" for i in range(60))


def low(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


@pytest.fixture(scope="module")
def odd(spark):
    base = " ".join(f"w{i % 37}x{i}" for i in range(400))
    near = base.replace("w3x40", "other").replace("w5x5", "Other")
    texts = [None, "", "   \n\t ", "one two", "One TWO", base, base, base.upper(), near, f"a start {PASSAGE} an end", f"{PASSAGE} more\n{PASSAGE}", "x " * 30000, "é" * 500 + " ▁ ☃ a  b\n\nc\x1f", "same line that is long enough\nsecond", "SAME line that is long enough \nthird", " same line that is long enough\nsame line that is long enough", "a b c d e f g a b c d e f g"]
    return spark.createDataFrame([(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", 0, "c", "c", "c") for i, t in enumerate(texts)], SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def docs_of(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def brute_groups(texts, n, percent):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(low(t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        common = Counter(j for x in s for j in holders[x] if j < i)
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def brute_spans(texts, window):
    seen, out = set(), {}
    for i in sorted(texts):
        found = WORD.findall(texts[i] or "")
        gone = [False] * len(found)
        for k in range(len(found) - window + 1):
            if (w := tuple(found[k : k + window])) in seen:
                gone[k : k + window] = [True] * window
            seen.add(w)
        out[i] = (len(found), sum(gone), " ".join(w for w, g in zip(found, gone) if not g))
    return out


def check_groups(df, n, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(df, n, percent).collect()}
    assert got == brute_groups(texts_of(df), n, percent)


def test_jaccard(spark, sf, odd, empty):
    check_groups(docs_of(spark, sf), 4, 85)
    check_groups(odd, 4, 85)
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_jaccard_on_a_family_of_near_copies(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        text = list(base)
        for k in rng.choice(120, rng.integers(1, 7), replace=False):
            text[k] = f"n{i}x{k}"
        rows.append((i, " ".join(text)))
    check_groups(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)
    check_groups(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)


def test_signatures_that_many_documents_hold(spark, monkeypatch):
    """Families that share most signatures, dealt by parts of a few documents."""
    rng = np.random.default_rng(12)
    rows = []
    for family in range(2):
        base = [f"f{family}w{i}" for i in range(100)]
        for i in range(90):
            text = list(base)
            for k in rng.choice(100, rng.integers(0, 6), replace=False):
                text[k] = f"n{family}x{i}x{k}"
            rows.append((len(rows), " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard_join, "PART_HOLDERS", 10)
    with jaccard_join.scratch(spark):
        described = jaccard_join._described(docs.select(F.col("doc_id").alias("id"), "text"), 4, 85)
        hot = jaccard_join._hot_signatures(described, described.select("id", F.explode("signatures").alias("signature"))).collect()
        assert len(hot) > 20 and all(r["n"] > 10 and r["parts"] == -(-r["n"] // 10) for r in hot)
    check_groups(docs, 4, 85)
    monkeypatch.setattr(jaccard_join, "HOT_SIGNATURES", 3)
    check_groups(docs, 4, 85)


def test_spans(spark, sf, odd, empty):
    for df in (docs_of(spark, sf), odd):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.remove_repeats(df, 20).collect()}
        assert got == brute_spans(texts_of(df), 20)
    assert substring_dedup.remove_repeats(empty, 20).count() == 0


def test_suffix_automaton():
    rng = np.random.default_rng(1)
    known = [[b"%d" % x for x in rng.integers(0, 3, 30)] for _ in range(4)]
    asked = [b"%d" % x for x in rng.integers(0, 3, 60)]
    automaton = substring_dedup.SuffixAutomaton()
    for k in known:
        automaton.add(k)
    inside = lambda part: any(k[i : i + len(part)] == part for k in known for i in range(len(k)))
    want = [max(n for n in range(i + 2) if inside(asked[i + 1 - n : i + 1])) for i in range(len(asked))]
    assert automaton.matches(asked) == want


def test_exact(odd, empty):
    got = {r["doc_id"]: r for r in exact_dedup.dedup_exact(odd).collect()}
    texts = {i: low(t or "") for i, t in texts_of(odd).items()}
    for i, t in texts.items():
        same = [j for j, u in texts.items() if u == t]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (max(same), len(same), i == max(same), hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup.dedup_exact(empty).count() == 0


def test_digest_index_lasts(spark, odd, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    assert exact_dedup.dedup_exact(odd, index).where("kept").count() == len({low(t or "") for t in texts_of(odd).values()})
    again = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    later = odd.withColumn("doc_id", F.col("doc_id") + 1000)
    assert exact_dedup.dedup_exact(later, again).where("kept").count() == 0


def test_lines(spark, odd, empty, tmp_path):
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.dedup_lines(odd).collect()}
    texts, holders = texts_of(odd), defaultdict(set)
    key = lambda x: low(x.strip(" \t\n\v\f\r"))
    for i, t in texts.items():
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    for i, t in texts.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3 or i == max(holders[key(x)])]
        assert got[i] == (len(lines), len(lines) - len(kept), "\n".join(kept))
    assert line_dedup.dedup_lines(empty).count() == 0
    runs = line_dedup.LineRuns(spark, str(tmp_path / "runs"), 2)
    line_dedup.dedup_lines(odd, runs=runs, batches=4)
    assert max(level for level, _, _ in line_dedup.LineRuns(spark, str(tmp_path / "runs"), 2).live) >= 1
    assert runs.unseen(line_dedup.hashed_lines(odd, 20, "doc_id", "text")).count() == 0


def test_mixing(odd, empty):
    got = mixing.mix(odd, [3, 1, 2]).collect()
    sizes = {i: len(WORD.findall(t or "")) for i, t in texts_of(odd).items()}
    assert {r["doc_id"]: r["size"] for r in got} == sizes
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    for rows in by.values():
        assert sum(r["taken"] for r in rows) == int(rows[0]["target"])
    assert sum(rows[0]["target"] for rows in by.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(odd, [3, 1, 2]).collect()), key=str)
    assert mixing.mix(empty, [3, 1, 2]).count() == 0


def test_language(spark, sf, odd, empty):
    docs = docs_of(spark, "/root/testdata/sf0.01")
    net = language_id.fit(docs, ~queries.held_out())
    found = language_id.predict(docs, net).join(docs.select("doc_id", "lang"), "doc_id").where(queries.held_out())
    assert found.where("lang = lang_pred").count() >= 0.97 * found.count()
    got = {r["doc_id"]: r for r in language_id.predict(odd, net).collect()}
    assert all(got[i]["lang_pred"] == "und" for i in (0, 1, 2)) and all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.fit(empty, F.lit(True)) is None
    assert {r["lang_pred"] for r in language_id.predict(odd, None).collect()} == {"und"}
    assert language_id.predict(empty, net).count() == 0


def test_windows_cover_whole_texts():
    data = np.arange(700, dtype=np.uint8) + 1
    bounds = np.array([0, 300, 300, 700])
    start, row = language_id.places(bounds)
    windows = language_id.cut(data, start, bounds[1:][row])
    assert row.tolist() == [0, 0, 0, 2, 2, 2, 2]
    assert b"".join(w[: language_id.WINDOW].tobytes() for w in windows[:3])[:300] == data[:300].tobytes()


def test_pieces(odd, empty):
    path = queries.tokenizer_path(queries.PIECE_MODEL)
    encoded = sentence_pieces.encode(odd, path, 5, keep=("text",))
    rows = sentence_pieces.decode(encoded, path).collect()
    assert all(r["decoded"] == r["text"] for r in rows) and len(rows) == odd.count()
    again = {r["doc_id"]: r["pieces"] for r in sentence_pieces.encode(odd.repartition(3), path, 5).collect()}
    assert again == {r["doc_id"]: r["pieces"] for r in rows}
    other = {r["doc_id"]: r["pieces"] for r in sentence_pieces.encode(odd, path, 6).collect()}
    assert other != again
    assert sentence_pieces.encode(empty, path).count() == 0


def test_pieces_are_drawn_by_their_weights():
    path = queries.tokenizer_path(queries.PIECE_MODEL)
    lattices = sentence_pieces.Lattices(sentence_pieces.Vocabulary(path, 1.0))
    v, text = lattices.vocabulary, " then"
    ways = {}

    def walk(end, pieces, weight):
        if not end:
            ways[tuple(reversed(pieces))] = weight
        for n, piece, w in v.ending(text, end) if end else ():
            walk(end - n, [*pieces, piece], weight * w)

    walk(len(text), [], 1.0)
    total = sum(ways.values())
    n = 20000
    out, count = sentence_pieces.sample_texts(lattices, ["then"] * n, words.mix(np.arange(n, dtype=np.uint64)))
    seen = Counter(tuple(x.tolist()) for x in np.split(out, np.cumsum(count)[:-1]))
    assert all(abs(seen[k] / n - w / total) < 0.015 for k, w in ways.items())


def test_tokens(spark, sf, odd, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(queries.TOKENIZER)
    library = Tokenizer.from_file(path)
    special = spark.createDataFrame([(1, "a<|endoftext|>b c"), (2, "é  x\x1cy it's"), (3, "z" * 5000)], "doc_id long, text string")
    for df in (docs_of(spark, sf), odd, special):
        texts = texts_of(df)
        for r in token_counts.with_token_counts(df, path, 2048).collect():
            text = texts[r["doc_id"]] or ""
            assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(library.encode(text, add_special_tokens=False)))
    assert token_counts.with_token_counts(empty, path, 2048).count() == 0


def test_rules(spark, sf, odd, empty):
    for df in (docs_of(spark, sf), odd):
        texts = texts_of(df)
        for r in quality_rules.apply_rules(df).collect():
            text = texts[r["doc_id"]] or ""
            w = WORD.findall(text)
            grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
            hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
            lines = [x for x in text.split("\n") if WORD.search(x)]
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))
            failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
            lost = sum(len(WORD.findall(x)) for x in text.split("\n") if quality_rules.line_fails(x, len(WORD.findall(x))))
            assert (r["base_failed"], r["kept"]) == (failed, not failed and lost <= 0.5 * len(w))
    assert quality_rules.apply_rules(empty).count() == 0
    assert quality_rules.line_fails("Home | About | Contact | Help", 7) == "navigation"
    assert quality_rules.line_fails("A plain sentence, with an end.", 6) is None


def test_classifier(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    docs, labels = docs_of(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    model = quality_classifier.fit(docs, labels.where(fold > 0))
    got = quality_classifier.classify(docs, model, labels.where(fold > 0)).join(labels.where(fold == 0), "doc_id")
    assert got.where("kept = (quality = 1)").count() >= 0.95 * got.count()
    assert got.where("quality = 1 AND kept").count() >= 0.98 * got.where("quality = 1").count()
    assert quality_classifier.classify(odd, model).count() == odd.count()
    none = quality_classifier.fit(empty, labels)
    assert quality_classifier.classify(empty, none).count() == 0
    assert quality_classifier.classify(odd, none).count() == odd.count()


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = docs_of(spark, sf)
    for name, stage in p.STAGES:
        out = stage(spark, docs, sf)
        rows = [r.asDict() for r in out.collect()]
        if name != p.STAGES[-1][0]:
            assert out.columns == docs.columns
        if name == "near duplicates":
            groups = brute_groups(texts_of(docs), 5, 80)
            assert {r["doc_id"] for r in rows} == {root for _, root in groups.values()}
        if name == "mixing":
            assert {r["doc_id"] for r in rows} <= set(texts_of(docs))
        if name == "sentence pieces":
            assert all(r["lossless"] for r in rows) and len(rows) == docs.count()
        else:
            docs = spark.createDataFrame(rows, docs.schema)


def test_pieces_of_more_chunks_than_the_table_has_rows(monkeypatch):
    path, seeds = queries.tokenizer_path(queries.PIECE_MODEL), words.mix(np.arange(3, dtype=np.uint64))
    texts = [" ".join(f"w{i}x{i * i}" for i in range(2000)), "", "one two\n " + "y" * 100 + " three"]
    wanted = sentence_pieces.sample_texts(sentence_pieces.Lattices(sentence_pieces.Vocabulary(path, 0.25)), texts, seeds)
    monkeypatch.setattr(sentence_pieces, "TABLE_ROWS", 300)
    found = sentence_pieces.sample_texts(sentence_pieces.Lattices(sentence_pieces.Vocabulary(path, 0.25)), texts, seeds)
    assert all(np.array_equal(a, b) for a, b in zip(found, wanted, strict=True)) and len(wanted[1]) == 3


def test_every_ordinary_piece_is_in_the_vocabulary():
    import sentencepiece

    path = queries.tokenizer_path(queries.PIECE_MODEL)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = {model.id_to_piece(i).replace(sentence_pieces.MARK, " "): i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
    v = sentence_pieces.Vocabulary(path, 0.25)
    assert v.ids == ordinary and v.longest == max(map(len, ordinary))
    # The lattices of tables have the long ones too, with the probabilities of the plain filter.
    lattices = sentence_pieces.Lattices(v)
    for text in (" relationship", " implementation", " " * 16, "=" * 20):
        lattices.learn({text})
        forward = [1.0]
        for end in range(1, len(text) + 1):
            here = [(n, i, w * forward[end - n]) for n, i, w in v.ending(text, end)]
            forward.append(sum(x[2] for x in here))
            row = lattices.base[text] + end - 1
            p = np.diff(lattices.cumulative[row], prepend=0)
            assert {n + 1: int(lattices.pieces[row, n]) for n in np.flatnonzero(p)} == {n: i if i < sentence_pieces.BYTES else lattices.none for n, i, _ in here}
            assert [p[n - 1] for n, _, _ in here] == pytest.approx([x[2] / forward[-1] for x in here], abs=1e-6)


def test_lines_of_a_job_that_runs_again_count_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, "a line that two documents hold") for i in range(2)], "doc_id long, text string")
    for _ in range(2):
        runs = line_dedup.LineRuns(spark, str(tmp_path / "runs"))
        assert [r["n_dropped"] for r in line_dedup.dedup_lines(docs, 3, 20, runs, name="monday").collect()] == [0, 0]
    later = docs.withColumn("doc_id", F.col("doc_id") + 10)
    found = line_dedup.dedup_lines(later, 3, 20, line_dedup.LineRuns(spark, str(tmp_path / "runs")), name="tuesday").collect()
    assert {r["doc_id"]: r["n_dropped"] for r in found} == {10: 1, 11: 0}


def test_classifier_against_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = [(i, " ".join("word%d," % k for k in rng.integers(0, 40, int(rng.integers(5, 90)))) + "." * (i % 3), f"h{i % 4}" if i % 13 else None, ["de", "en", None][i % 3]) for i in range(200)]
    rows.append((None, "one more text without an id", "alone", "en"))
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string, lang string").withColumn("host", F.lit("clash")).withColumn("good", F.lit(1))
    label = {i: int(rng.integers(0, 2)) for i in range(0, 200, 3)}
    table = lambda known: spark.createDataFrame([(i, y, 0) for i, y in known.items()], "doc_id int, quality int, toxic int")
    model = quality_classifier.fit(docs, table(label))
    found = {r["doc_id"]: r for r in quality_classifier.classify(docs, model, table(label)).collect()}
    data, bounds = words.flat(__import__("pyarrow").array([r[1] for r in rows]))
    odds = model.log_odds(quality_classifier.features(data, bounds))
    p = 1 / (1 + np.exp(-odds))
    y = np.array([label.get(r[0], q) for r, q in zip(rows, p, strict=True)], float)
    host = [r[2] for r in rows]
    path = [(r[2], r[3]) for r in rows]

    def strength(mean, groups, centre):
        x = sum(len(g) * (p[g].mean() - centre(g)) ** 2 - centre(g) * (1 - centre(g)) for g in groups) / len(rows)
        return min(max(mean * (1 - mean) / max(x, 1e-9) - 1, 2.0), 10_000.0)

    members = lambda keys: [np.array([i for i, k in enumerate(keys) if k == key]) for key in dict.fromkeys(keys)]
    mean = p.mean()
    a = strength(mean, members(host), lambda g: mean)
    shrunk = {host[g[0]]: (a * mean + p[g].sum()) / (a + len(g)) for g in members(host)}
    b = strength(mean, members(path), lambda g: shrunk[host[g[0]]])
    logit = lambda x: np.log(max(x, 1e-6) / max(1 - x, 1e-6))
    for i, r in enumerate(rows):
        others = lambda keys, i=i: y[[k for k in range(len(rows)) if keys[k] == keys[i] and k != i]]
        rate = np.delete(y, i).mean()
        h = (a * rate + others(host).sum()) / (a + len(others(host)))
        s = (b * h + others(path).sum()) / (b + len(others(path)))
        posterior = 1 / (1 + np.exp(-(odds[i] + np.clip(logit(s) - logit(rate), -4, 4))))
        got = found[r[0]]
        assert (got["host_rate"], got["site_rate"], got["posterior"]) == pytest.approx((h, s, posterior), abs=1e-9)
        assert got["kept"] == (got["posterior"] >= 0.5)
    # A document's own label never changes its row.
    for i in (0, 3, 99):
        other = quality_classifier.classify(docs, model, table(label | {i: 1 - label[i]})).where(F.col("doc_id") == i).first()
        assert other["posterior"] == pytest.approx(found[i]["posterior"], abs=1e-12)


def test_sites_of_one_document_ignore_its_label(spark):
    docs = spark.createDataFrame([(i, "", f"h{i}", "en") for i in range(60)], "doc_id long, text string, source string, lang string")
    model = quality_classifier.fit_features(np.zeros((0, 12)), np.zeros(0))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    got = [r["posterior"] for r in quality_classifier.classify(docs, model, labels).orderBy("doc_id").collect()]
    flipped = [r["posterior"] for r in quality_classifier.classify(docs, model, labels.withColumn("quality", F.when(F.col("doc_id") == 7, 0).otherwise(F.col("quality")))).orderBy("doc_id").collect()]
    assert got[7] == pytest.approx(flipped[7], abs=1e-12)


def test_network_against_a_plain_one():
    """The forward pass by loops."""
    rng = np.random.default_rng(2)
    filters = 3 * language_id.FILTERS
    width = np.repeat(language_id.WIDTHS, language_id.FILTERS)
    live = (np.arange(4)[:, None, None] < width).astype(np.float32)
    net = language_id.ByteNet(["a", "b", "c"], (rng.normal(0, 0.3, (4, 256, filters)) * live).astype(np.float32), rng.normal(0, 0.1, filters).astype(np.float32), rng.normal(0, 0.2, (filters, 3)).astype(np.float32), rng.normal(0, 0.1, 3).astype(np.float32))
    texts = [bytes(rng.integers(1, 256, n, dtype=np.uint8)) for n in (1, 5, 128, 129, 700)] + [b""]
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.cumsum([0, *map(len, texts)])

    def plain(text):
        total, n = np.zeros(3), 0
        for at in range(0, len(text), language_id.WINDOW):
            window = text[at : at + language_id.WINDOW + 3].ljust(language_id.WINDOW + 3, b"\0")
            pooled = [max(0.0, max(sum(float(net.taps[k, window[i + k], f]) for k in range(width[f])) for i in range(language_id.WINDOW)) + float(net.bias[f])) for f in range(filters)]
            total += np.array(pooled) @ net.top + net.top_bias
            n += 1
        return total / max(n, 1)

    assert np.allclose(net.log_scores(data, bounds), [plain(t) for t in texts], atol=1e-4)
    small = language_id.AT_ONCE
    try:
        language_id.AT_ONCE = 2
        assert np.allclose(net.log_scores(data, bounds), [plain(t) for t in texts], atol=1e-4)
    finally:
        language_id.AT_ONCE = small


def test_first_step_follows_the_gradient(monkeypatch):
    """Adam's first step moves each weight by the sign of its gradient, which differences of the loss give."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(language_id, "FILTERS", 3)
    monkeypatch.setattr(language_id, "BATCH", 100)
    windows, y = rng.integers(97, 103, (12, language_id.WINDOW + 3)).astype(np.uint8), rng.integers(0, 2, 12)
    nets = []
    for epochs in (0, 1):
        monkeypatch.setattr(language_id, "EPOCHS", epochs)
        nets.append(language_id.train(windows, y, ["x", "z"]))
    before, after = nets
    names = ["taps", "bias", "top", "top_bias"]
    wide = language_id.ByteNet(before.langs, *[getattr(before, k).astype(np.float64) for k in names])

    def loss():
        logits = wide.convolve(windows).max(1) + wide.bias
        logits = np.maximum(logits, 0) @ wide.top + wide.top_bias
        logits = logits - logits.max(1, keepdims=True)
        return (np.log(np.exp(logits).sum(1)) - logits[np.arange(len(y)), y]).mean()

    checked = 0
    for k in names:
        weights, moved = getattr(wide, k), getattr(after, k) - getattr(before, k)
        for at in rng.permutation(np.argwhere(moved != 0))[:60]:
            at, was = tuple(at), weights[tuple(at)]
            weights[at] = was + 1e-5
            up = loss()
            weights[at] = was - 1e-5
            slope = (up - loss()) / 2e-5 + language_id.DECAY * was
            weights[at] = was
            if abs(slope) > 1e-4:
                assert np.sign(moved[at]) == -np.sign(slope), (k, at)
                checked += 1
    assert checked > 20


def test_training_lowers_the_loss_and_finds_planted_bytes():
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 6000)
    windows = rng.integers(97, 123, (6000, language_id.WINDOW + 3)).astype(np.uint8)
    for i, k in enumerate(y):
        at = rng.integers(0, 100)
        windows[i, at : at + 3] = list(b"#!%" if k else b"%#!")
    net = language_id.train(windows, y, ["x", "z"])
    assert (net.logits(windows).argmax(1) == y).mean() > 0.95


def test_long_texts_of_tokens(monkeypatch):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(queries.TOKENIZER)
    library = Tokenizer.from_file(path)
    rng = np.random.default_rng(1)
    run = " ".join(f"w{i}x" for i in rng.integers(0, 3000, 900_000))
    limit = token_counts.STRETCH_BYTES
    for text in (run, "ab1c" * 1_250_000, " " * limit + "a b" + " \n" * limit):
        stretches = list(token_counts._stretches(text.encode()))
        assert b"".join(stretches) == text.encode() and all(len(s) <= limit or not s.strip().split()[1:] for s in stretches)
        assert token_counts.lengths(path, [text.encode()]) == [len(library.encode(text, add_special_tokens=False))]
    monkeypatch.setattr(token_counts, "STRETCH_BYTES", 7)
    for text in ("", " ", "a b c d e f g h i", "abcdefghijkl mn", "       x", "ab cdefghij  kl"):
        assert b"".join(token_counts._stretches(text.encode())) == text.encode()
        assert token_counts.lengths(path, [text.encode()]) == [len(library.encode(text, add_special_tokens=False))]


def test_hashes_of_long_words(monkeypatch):
    data = np.frombuffer(b"abc " + b"xyZq" * 3000 + b" def xyzq", np.uint8)
    starts, ends, _ = words.spans(data, np.array([0, len(data)]))
    wanted = words.hashes(data, starts, ends, True)
    monkeypatch.setattr(words, "GROUP_BYTES", 64)
    assert (words.hashes(data, starts, ends, True) == wanted).all()


def test_long_chunks_are_drawn_as_short_ones_are(monkeypatch):
    path, seeds = queries.tokenizer_path(queries.PIECE_MODEL), words.mix(np.arange(6, dtype=np.uint64))
    texts = ["aninternationalrelationship", "x" * 31, "é☃" * 15, "=" * 16 + "implementationdetails", "one two", ""]
    wanted = sentence_pieces.sample_texts(sentence_pieces.Lattices(sentence_pieces.Vocabulary(path, 0.25)), texts, seeds)
    for chars, ends in ((3, 1 << 15), (3, 5), (0, 1)):
        monkeypatch.setattr(sentence_pieces, "TABLE_CHARS", chars)
        monkeypatch.setattr(sentence_pieces, "BLOCK_ENDS", ends)
        found = sentence_pieces.sample_texts(sentence_pieces.Lattices(sentence_pieces.Vocabulary(path, 0.25)), texts, seeds)
        assert all(np.array_equal(a, b) for a, b in zip(found, wanted, strict=True))


def test_a_piece_of_the_greatest_length_is_drawn_and_decoded(spark):
    path = queries.tokenizer_path(queries.PIECE_MODEL)
    docs = spark.createDataFrame([(i, " implementation" * 40) for i in range(40)], "doc_id long, text string")
    encoded = sentence_pieces.encode(docs, path, 3, alpha=1.0, keep=("text",)).cache()
    spelled = sentence_pieces.spelled(path)
    assert max(len(spelled[i]) for r in encoded.collect() for i in r["pieces"]) >= 14
    assert all(r["decoded"] == r["text"] for r in sentence_pieces.decode(encoded, path).collect())
    encoded.unpersist()


@pytest.mark.parametrize("kind", ["int", "string", "bigint"])
def test_spans_with_hot_anchors_and_ids_of_any_type(spark, monkeypatch, kind):
    rng = np.random.default_rng(8)
    phrase = " ".join(f"common{i}" for i in range(12))
    draw = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 200, n))
    tail = draw(40)
    texts = [f"{draw(12)} {phrase} {draw(12)}" for _ in range(60)] + [f"{draw(5)} {phrase} {tail}" for _ in range(25)] + [tail, tail, f"{phrase} {tail} {phrase} {tail}", None, ""]
    rows = [(i + 100, t) for i, t in enumerate(texts)]
    want = brute_spans(dict(rows), 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string").select(F.col("doc_id").cast(kind), "text", F.lit(1).alias("id"), F.lit("x").alias("anchor"))
    for most in (1000, 40, 1):
        monkeypatch.setattr(substring_dedup, "HOT_STRETCHES", most)
        got = {int(r["doc_id"]): (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.remove_repeats(docs, 20).collect()}
        assert got == want


def test_no_shard_grows_with_a_phrase(spark, monkeypatch):
    """A phrase that stands a few times in every part of the corpus is never rare enough to grow a shard."""
    rng = np.random.default_rng(21)
    phrase = " ".join(f"common{i}" for i in range(30))
    draw = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 3000, n))
    rows = [(i, f"{draw(60)} {phrase} {draw(60)}" if i % 4 == 0 else draw(120)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    monkeypatch.setattr(substring_dedup, "HOT_STRETCHES", 20)
    with substring_dedup.scratch(spark):
        single, _ = substring_dedup._single(docs.select(F.col("doc_id").alias("id"), "text"), 20)
        places = substring_dedup._places(single, 20)
        assert places.where("size(hot) > 0").count() == 100
        cold = places.select("id", F.explode("cold").alias("place"))
        assert cold.count() < 100  # the phrase's inner anchors are all hot; those at its ends stand once
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.remove_repeats(docs, 20).collect()}
    assert got == brute_spans(dict(rows), 20)


@pytest.fixture(scope="module")
def peculiar(spark):
    """Null and repeated ids, ids of type int, and columns named like those inside the operators."""
    rng = np.random.default_rng(4)
    base = " ".join(f"w{i}," for i in rng.integers(0, 900, 120)) + "."
    near = base.replace("w1", "v1", 1)
    rows = [(None, base), (None, "one line that is long enough\nx"), (7, base), (7, near), (8, None), (8, ""), (9, base.upper()), (10, "one line that is long enough"), (11, "One line that is long enough\ny z"), (12, "one line that is long enough\nq"), (13, base), (13, base)]
    docs = spark.createDataFrame([(i, t, "en" if n % 3 else None, f"s{n % 2}" if n % 4 else None, 0) for n, (i, t) in enumerate(rows)], "doc_id int, text string, lang string, source string, n_chars int")
    for name in ("id", "key", "h1", "place", "signature", "size", "odds", "anchor", "n_words", "__id", "words_key"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


def test_operators_on_null_and_repeated_ids(spark, peculiar):
    n, ids = peculiar.count(), sorted((r["doc_id"] for r in peculiar.select("doc_id").collect()), key=str)
    path = queries.tokenizer_path(queries.PIECE_MODEL)
    found = {
        "mix": mixing.mix(peculiar, [3, 1, 2]), "lang": language_id.predict(peculiar, None), "lines": line_dedup.dedup_lines(peculiar), "rules": quality_rules.apply_rules(peculiar),
        "near": jaccard_join.near_duplicates(peculiar, 4, 85), "spans": substring_dedup.remove_repeats(peculiar, 20), "tokens": token_counts.with_token_counts(peculiar, queries.tokenizer_path(queries.TOKENIZER), 9),
        "pieces": sentence_pieces.encode(peculiar, path), "quality": quality_classifier.classify(peculiar, quality_classifier.fit(peculiar.limit(0), spark.createDataFrame([(7, 1)], "doc_id int, quality int"))),
        "exact": exact_dedup.dedup_exact(peculiar),
    }
    rows = {name: df.collect() for name, df in found.items()}
    assert {name: sorted((r["doc_id"] for r in x), key=str) for name, x in rows.items()} == dict.fromkeys(rows, ids) and n == 12
    # Rows without an id keep their lines and words, and belong to no group; the others see each other only.
    assert all(r["n_dropped"] == 0 for r in rows["lines"] if r["doc_id"] is None)
    assert {r["doc_id"]: r["n_dropped"] for r in rows["lines"] if r["doc_id"] in (10, 11, 12)} == {10: 1, 11: 1, 12: 0}
    assert all(r["n_removed"] == 0 for r in rows["spans"] if r["doc_id"] is None)
    assert all(r["n_removed"] == r["n_words"] for r in rows["spans"] if r["doc_id"] == 13)
    assert {(r["doc_id"], r["component_id"]) for r in rows["near"]} == {(None, None), (7, 7), (8, 8), (9, 7), (10, 10), (11, 11), (12, 12), (13, 7)}


def test_pipeline_on_null_and_repeated_ids_and_on_no_rows(spark, sf, peculiar):
    import corpus_pipeline as p

    stages = dict(p.STAGES)
    docs = peculiar.select("doc_id", "text", "lang", "source", "n_chars")
    near = stages["near duplicates"](spark, docs, sf)
    assert sorted((r["doc_id"] for r in near.collect()), key=str) == sorted([7, 7, 8, 8, 10, 11, 12, None, None], key=str)
    lines = stages["line dedup"](spark, docs, sf).collect()
    # 10 would lose all its text, so it is left out; 11 keeps its second line.
    assert {r["text"] for r in lines if r["doc_id"] in (10, 11, 12)} == {"y z", "one line that is long enough\nq"}
    assert sum(r["doc_id"] is None for r in lines) == 2 and all(r["n_chars"] == len(r["text"]) for r in lines if r["text"])
    mixed = stages["mixing"](spark, docs, sf).groupBy("doc_id", "text").count().collect()
    times = {i: {r["count"] for r in mixed if r["doc_id"] == i and r["text"]} for i in (None, 7)}
    assert all(len(x) <= 1 for x in times.values()) and all(r["text"] for r in mixed if r["doc_id"] != 8)
    assert stages["quality classifier"](spark, docs, sf).where("doc_id = 7").count() in (0, 2)
    out = stages["sentence pieces"](spark, docs, sf).collect()
    assert len(out) == 12 and all(r["lossless"] for r in out)
    docs = docs.limit(0)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_many_lost_lines_and_a_rerun(spark, tmp_path):
    text = "\n".join(f"a long shared line number {i}" for i in range(20_000))
    docs = spark.createDataFrame([(i, f"own {i}\n{text}\nown {i}") for i in range(3)], "doc_id long, text string")
    for name in ("first", "first"):
        runs = line_dedup.LineRuns(spark, str(tmp_path / "runs"))
        got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.dedup_lines(docs, runs=runs, name=name).collect()}
        assert got == {i: (20_002, 20_000, f"own {i}\nown {i}") for i in range(2)} | {2: (20_002, 0, f"own 2\n{text}\nown 2")}
    assert runs.merged().agg(F.max("n_docs")).first()[0] == 3
    assert runs.rows("new").count() == runs.rows("new").select("h1", "h2").distinct().count() == 20_000


def test_sketches_of_any_size_never_rule_a_link_out():
    rng = np.random.default_rng(6)
    for size in (1, 500, 2048, 2049, 9000):
        a = np.unique(rng.integers(0, 2**64, size, np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * 0.93)], rng.integers(0, 2**64, max(1, size // 20), np.uint64)]))
        x, y = (np.frombuffer(jaccard_join.sketch(s), np.uint64) for s in (a, b))
        least = min(len(x), len(y))
        apart = int(np.bitwise_count(jaccard_join.folded(x, least) ^ jaccard_join.folded(y, least)).sum())
        assert apart <= len(np.setxor1d(a, b)) and (size < 500 or apart > 0)


def test_common_chunks_stay_when_the_tables_are_full(monkeypatch):
    path, learned = queries.tokenizer_path(queries.PIECE_MODEL), 0
    monkeypatch.setattr(sentence_pieces, "TABLE_ROWS", 2000)
    lattices = sentence_pieces.Lattices(sentence_pieces.Vocabulary(path, 0.25))
    add = lattices.add

    def counted(points, size):
        nonlocal learned
        learned += int(size.sum())
        add(points, size)

    monkeypatch.setattr(lattices, "add", counted)
    common = [f"common{i:02}" for i in range(40)]
    texts = [" ".join([*common, *(f"rare{i}x{k}" for k in range(40))]) for i in range(60)]
    once = len({c for t in texts for c in t.split()}) * 10
    found = sentence_pieces.sample_texts(lattices, texts, words.mix(np.arange(60, dtype=np.uint64)))
    assert learned < 1.05 * once
    monkeypatch.undo()
    wanted = sentence_pieces.sample_texts(sentence_pieces.Lattices(sentence_pieces.Vocabulary(path, 0.25)), texts, words.mix(np.arange(60, dtype=np.uint64)))
    assert all(np.array_equal(a, b) for a, b in zip(found, wanted, strict=True))


def test_chunks_cut_at_once_are_those_of_each_text():
    texts = ["", " ", "\n", "a b", "a  b \n c\n\n  ", " x", "é\t☃ \x1c 😀", "z " * 50, "  \n", "q"]
    points, at, per = sentence_pieces._cut(texts)
    text = points.tobytes().decode("utf-32-le")
    chunks = [text[a:b] for a, b in zip(at, [*at[1:], len(text)], strict=True)]
    wanted = [re.findall(r"\n| *[^ \n]+| +", " " + t) for t in texts]
    assert chunks == [c for row in wanted for c in row] and per.tolist() == [len(row) for row in wanted]


def test_pieces_are_checked_in_the_pass_that_draws_them(spark, odd):
    path = queries.tokenizer_path(queries.PIECE_MODEL)
    encoded = sentence_pieces.encode(odd, path, 5, lossless_col="same")
    assert encoded.columns == ["doc_id", "pieces", "same"] and all(r["same"] for r in encoded.collect())
    assert {r["doc_id"]: r["pieces"] for r in encoded.collect()} == {r["doc_id"]: r["pieces"] for r in sentence_pieces.encode(odd, path, 5).collect()}
    # One worker a task, for the query and for the pipeline's stage alike.
    import corpus_pipeline

    docs = docs_of(spark, "/root/testdata/sf0.001")
    for df in (queries.op6_sentence_pieces(spark, "/root/testdata/sf0.001"), corpus_pipeline.pieces(spark, docs, "/root/testdata/sf0.001")):
        assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    # A table that spells a piece otherwise is found out.
    table = pa.array([x.upper() for x in sentence_pieces.spelled(path)], pa.binary())
    lattices = sentence_pieces.Lattices(sentence_pieces.Vocabulary(path, 0.25))
    pieces, count = sentence_pieces.sample_texts(lattices, ["abc", "ABC", ""], words.mix(np.arange(3, dtype=np.uint64)))
    assert list(sentence_pieces._spell(table, pa.array(pieces, pa.int32()), np.concatenate([[0], np.cumsum(count)]))) == [b"ABC", b"ABC", b""]


def test_a_worker_of_the_pieces_holds_little(spark, monkeypatch):
    # Two of them share an executor's memory with its JVM, and other stages' tables stay with a worker.
    words._powers.cache_clear()
    data = np.frombuffer(b"some words of a text " * 100_000, np.uint8)
    starts, ends, _ = words.spans(data, np.array([0, len(data)]))
    tracemalloc.start()
    hashed = words.hashes(data, starts, ends, True)
    kept = tracemalloc.get_traced_memory()[0] - hashed.nbytes
    tracemalloc.stop()
    assert kept < 4e6
    # What a task of a batch of many different words takes, beside the batch itself.
    runs, path, map_texts = [], queries.tokenizer_path(queries.PIECE_MODEL), sentence_pieces.map_texts
    monkeypatch.setattr(sentence_pieces, "map_texts", lambda rows, run, schema: [runs.append(run), map_texts(rows, run, schema)][1])
    sentence_pieces.encode(spark.createDataFrame([(1, "a")], "doc_id long, text string"), path, 5, lossless_col="same")
    rng = np.random.default_rng(8)
    texts = ["".join(np.array(list("abcdefghij  "))[rng.integers(0, 12, 4000)].tolist()) for _ in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(np.arange(500)), pa.array(np.arange(500))], ["text", "seed", "c0"])
    tracemalloc.start()
    rows = sum(len(x) for x in runs[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 500 and peak < 75e6, peak
