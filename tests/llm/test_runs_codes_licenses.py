"""Periodic runs, vector codes and licence scans against brute force, and on nulls, empty and long texts, ties, repeats, clashing names."""

import hashlib
import random
import re
from bisect import bisect_left
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from kinespark.llm import license_scan, periodic_runs, queries, vector_codes, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, id string, n_words string, runs string, labels string"


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "c", "c", "c", "c") for i, t in enumerate(texts)], SCHEMA)


def plain_runs(w, least, times):
    """The runs of w by comparing it with itself at each distance."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic(rng, n, alphabet):
    w = [f"w{rng.randrange(alphabet)}" for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 10:
            a, p = rng.randrange(n), rng.randint(1, 20)
            for i in range(a + p, min(n, a + p * rng.randint(2, 9))):
                w[i] = w[i - p]
    return w


@pytest.mark.parametrize("few", [0, 1, 4])
def test_runs_of_random_texts(monkeypatch, few):
    monkeypatch.setattr(periodic_runs, "FEW_CLASSES", few)
    rng, n = random.Random(few), 0
    for _ in range(150):
        texts = [periodic(rng, rng.randint(0, 160), rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(1, 4))]
        least, times = rng.choice([(24, 3), (9, 3), (5, 4), (12, 3)])
        data, bounds = words.flat(pa.array([" ".join(w) for w in texts]))
        starts, ends, first = words.spans(data, bounds)
        want = [plain_runs(w, least, times) for w in texts]
        assert periodic_runs.runs_of(words.hashes(data, starts, ends, lower=False), first, least, times) == want
        n += sum(map(len, want))
    assert n > 150


def test_suffix_order_and_common_lengths():
    rng = np.random.default_rng(2)
    for n in (1, 2, 30, 200):
        text = rng.integers(1, 3, n)
        order = periodic_runs.suffix_order(text)
        assert order.tolist() == sorted(range(n), key=lambda i: text[i:].tolist())
        common = periodic_runs.common_lengths(text.tolist(), order.tolist())
        for k in range(1, n):
            a, b = text[order[k - 1] :], text[order[k] :]
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert common[k] == same


def test_runs_of_tables(spark, sf):
    rng = random.Random(9)
    odd = [None, "", " \n\t", "one", "a " * 23, "a " * 24, "a\n" * 30, "A a " * 20, "x y z " * 9, "x y z " * 9, "é ☃ " * 12 + "é", " ".join(periodic(rng, 400, 3)), " ".join(f"w{i}" for i in range(200))]
    for df in (rows(spark, odd), queries.with_periods(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))):
        texts, n = {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}, 0
        for r in periodic_runs.collapse_runs(df).collect():
            w = WORD.findall(texts[r["doc_id"]])
            runs = plain_runs(w, 24, 3)
            assert (r["n_words"], [tuple(x) for x in r["runs"]]) == (len(w), runs)
            best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
            assert (r["strongest"] and tuple(r["strongest"])) == best
            gone = {i for s, size, q in runs for i in range(s + q, s + size)}
            assert r["collapsed_text"] == " ".join(x for i, x in enumerate(w) if i not in gone)
            n += len(runs)
        assert n >= 5
    assert periodic_runs.collapse_runs(rows(spark, [])).count() == 0
    twice = spark.createDataFrame([(None, "b " * 30), (None, "b " * 30), (1, None)], "doc_id long, text string")
    assert sorted(len(r["runs"]) for r in periodic_runs.collapse_runs(twice).collect()) == [0, 1, 1]


def test_runs_of_long_texts():
    passage = [f"p{k}" for k in range(40)]
    texts = {
        "one run": [f"w{i % 1000}" for i in range(200_000)],
        "many left words": [x for i in range(4000) for x in (f"n{i}", *passage)],
        "Thue-Morse": [str(bin(i).count("1") % 2) for i in range(1 << 16)],
    }
    found = {}
    for name, w in texts.items():
        data, bounds = words.flat(pa.array([" ".join(w)]))
        starts, ends, first = words.spans(data, bounds)
        found[name] = periodic_runs.runs_of(words.hashes(data, starts, ends, lower=False), first, 24, 3)[0]
    assert found == {"one run": [(0, 200_000, 1000)], "many left words": [], "Thue-Morse": []}


def test_periods_of_the_query(spark, sf):
    import zlib

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts, n_changed = {r["doc_id"]: r["text"] for r in docs.collect()}, 0
    for r in queries.with_periods(docs).collect():
        h, w = zlib.crc32(str(r["doc_id"]).encode()), WORD.findall(texts[r["doc_id"]] or "")
        g, n = h // 10, len(w)
        if h % 10 or not n:
            assert r["text"] == texts[r["doc_id"]]
            continue
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert r["text"] == " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(n))
        n_changed += 1
    assert n_changed
    tenth = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    none = spark.createDataFrame([(None, "a b"), (tenth, None), (tenth, ""), (tenth, " \n")], "doc_id long, text string")
    assert [r["text"] for r in queries.with_periods(none).collect()] == ["a b", None, "", " \n"]


def plain_codes(vectors, n_parts, n_entries, rounds):
    """(code, error) of each vector (id, components) that counts, and the codebooks, by loops."""
    real = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v)]
    width = len(real[0][1]) // n_parts
    part = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(real)[:n_entries]
    books = [[part(v, p) for _, v in first] for p in range(n_parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, book: min(range(len(book)), key=lambda k: (apart(x, book[k]), k))
    for _ in range(rounds):
        for p, book in enumerate(books):
            held = [[] for _ in book]
            for _, v in real:
                held[near(part(v, p), book)].append(part(v, p))
            books[p] = [[sum(c) // len(m) for c in zip(*m)] if m else old for m, old in zip(held, book)]
    out = []
    for i, v in real:
        chosen = [near(part(v, p), books[p]) for p in range(n_parts)]
        out.append((i, "".join(f"{k:02x}" for k in chosen), sum(apart(part(v, p), books[p][k]) for p, k in enumerate(chosen))))
    return out, hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()


def test_codes(spark):
    rng = np.random.default_rng(4)
    vectors = [(int(i), [float(np.float32(x)) for x in v]) for i, v in zip(rng.permutation(120), rng.normal(0, 0.3, (120, 8)))]
    same = [(1000 + i, [0.25] * 8) for i in range(150)]
    odd = [(5000, None), (5001, [None] * 8), (5002, [0.1] * 7 + [float("nan")]), (5003, [float("inf")] * 8), (5004, []), (5005, [-0.0] * 8), (5005, [-0.0] * 8)]
    table = [(i, v, None if i % 4 == 0 else i % 3, "c", "c", "c") for i, v in [*vectors, *same, *odd]]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int, v string, entry string, id string")
    want, digest = plain_codes([(i, v) for i, v, *_ in table], 4, 16, 2)
    got = vector_codes.compress(df, 4, 16, 2).collect()
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in got) == sorted(want)
    assert {r["codebooks_sha256"] for r in got} == {digest}
    label = {i: x for i, _, x, *_ in table}
    for r in got:
        assert r["label_error"] == sum(e for i, _, e in want if label[i] == label[r["vec_id"]])
    books = vector_codes.fit(df, 4, 16, 2)
    assert books.moved[0] == 4 * len(want) and 0 < books.moved[1] < books.moved[0]  # only parts that change entry move
    few = vector_codes.compress(df.where("vec_id = 5005"), 4, 16, 2).collect()
    assert [(r["code"], r["error"]) for r in few] == [("00000000", 0)] * 2
    assert vector_codes.compress(df.where("vec_id > 9000")).count() == 0
    assert vector_codes.compress(df.where("vec_id = 5000")).count() == 0
    huge = spark.createDataFrame([(None, [1e30, -1e30], 1), (2, [1.0, 2.0], 1), (3, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(r["code"] for r in vector_codes.compress(huge, 2, 2, 1).collect()) == ["0000", "0101"]
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.fit(huge, 3)


def test_nearest_is_exact_for_large_components():
    rng = np.random.default_rng(1)
    for most in (200, 1 << 26):
        parts, entries = rng.integers(-most, most, (300, 4)), rng.integers(-most, most, (20, 4))
        entries[7] = entries[3]
        index, distance = vector_codes.nearest(parts, entries)
        for x, k, d in zip(parts.tolist(), index.tolist(), distance.tolist()):
            want = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in entries.tolist()]
            assert (k, d) == (want.index(min(want)), min(want))


def plain_matches(templates, w):
    """The longest match at each word that isn't extended, by comparing with all templates: (template, its end, start, end)."""
    longest = []
    for i in range(len(w)):
        n = max((k for t in templates for e in range(1, len(t) + 1) for k in [next((k for k in range(min(e, i + 1)) if t[e - 1 - k] != w[i - k]), min(e, i + 1))]), default=0)
        longest.append(n)
    out = set()
    for i, n in enumerate(longest):
        if n >= license_scan.MIN_MATCH and (i + 1 == len(w) or longest[i + 1] <= n):
            out |= {(k, e, i + 1 - n, i + 1) for k, t in enumerate(templates) for e in range(n, len(t) + 1) if t[e - n : e] == w[i + 1 - n : i + 1]}
    return sorted(out)


def test_matches_and_phrases(spark, sf):
    rng = random.Random(3)
    mine = {"x": ["one two three four five six seven", "a b c d e f"], "y": ["three four five six nine ten", "a b c d one two"]}
    vocabulary = ["one", "two", "three", "four", "five", "six", "seven", "nine", "ten", "a", "b", "c", "d", "e", "f", "other"]
    listed = [(label, t) for label, ts in mine.items() for t in ts]
    found = license_scan.Templates(listed, [])
    sequences = [t.split() for _, t in listed]
    for _ in range(100):
        w = [x for _ in range(5) for x in (rng.choice(sequences)[rng.randrange(3) : rng.randint(3, 7)] if rng.random() < 0.7 else [rng.choice(vocabulary)])]
        hashed = license_scan._hashed(pa.array([" ".join(w)]))[1].tolist()
        got = sorted(found.matches(hashed, 0))
        assert got == plain_matches(sequences, w)
    odd = [None, "", "MIT", "The MIT-License, the mit License; APACHE\nLICENSE. General public license", "mit licenses", "xmit license", "mit é license", "MIT\x00license", "license " * 3 + "mit " * 3 + "license"]
    for df in (rows(spark, odd), spark.read.parquet(f"{sf}/documents.parquet")):
        texts = {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}
        for r in license_scan.scan_licenses(df).collect():
            w = TOKEN.findall(texts[r["doc_id"]].translate({i: i + 32 for i in range(65, 91)}))
            places = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
            base = {label for _, label in places}
            assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(places), ",".join(sorted(base)))
            assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
            labels = base | {s["label"] for s in r["spans"]}
            assert r["labels"] == ",".join(sorted(labels)) and 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(labels)
            for s in r["spans"]:
                assert 0 <= s["first"] < s["after"] <= len(w) and s["share"] >= license_scan.LEAST_SHARE
    assert license_scan.scan_licenses(rows(spark, [])).count() == 0


def plain_chain(matches):
    """The weight of the heaviest chain, by trying all subsets."""
    best = 0
    for mask in range(1, 1 << len(matches)):
        chain = sorted((m for k, m in enumerate(matches) if mask >> k & 1), key=lambda m: (m[3], m[1]))
        weight = chain[0][3] - chain[0][2]
        for a, b in zip(chain, chain[1:]):
            shared = max(0, a[3] - b[2], a[1] - (b[1] - b[3] + b[2]))
            rises = a[2] < b[2] and a[1] < b[1] and a[1] - (a[3] - a[2]) < b[1] - (b[3] - b[2]) and b[2] - a[3] <= license_scan.GAP
            weight = weight + b[3] - b[2] - shared if rises else -(10**9)
        best = max(best, weight)
    return best


def test_chains():
    rng = random.Random(8)
    for _ in range(200):
        ends = sorted(rng.sample(range(6, 120), 7))
        matches = []
        for k, high in enumerate(ends):
            low = max(high - rng.randint(4, 12), matches[-1][2] + 1 if matches else 0)
            if high - low >= 4:
                matches.append((0, high - low + rng.randint(0, 60), low, high))
        if matches:
            spans = license_scan.chains(matches)
            assert spans[0][3] == plain_chain(matches)
    assert license_scan.chains([]) == []


def test_whole_and_damaged_licences(spark):
    mit, gpl = license_scan.TEMPLATES["mit"][3], license_scan.TEMPLATES["gpl"][3]
    damaged = mit.split()
    for k in range(15, len(damaged), 16):
        damaged[k] = "changed"
    long = " ".join(f"x{i}" for i in range(30000)) + " " + mit + " filler" * 500 + " " + gpl.upper()
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(rows(spark, [mit, " ".join(damaged), " ".join(mit.split()[:20]), long, " ".join(reversed(mit.split())), (mit + " ") * 300])).collect()}
    assert got[0]["labels"] == "mit" and got[0]["score"] == 1.0 and [(s["first"], s["after"]) for s in got[0]["spans"]] == [(0, len(TOKEN.findall(mit.lower())))]
    assert got[1]["labels"] == "mit" and 0.6 < got[1]["score"] < 1
    assert got[2]["labels"] == "" and got[2]["score"] == 0
    assert got[3]["labels"] == "gpl,mit" and [s["first"] for s in got[3]["spans"]][0] == 30000
    assert got[4]["labels"] == ""
    assert len(got[5]["spans"]) == 300 and got[5]["labels"] == "mit"


def test_vocabulary_is_found_exactly():
    found = license_scan.Templates([("x", "one two three four")], [])
    assert all(found.vocabulary[bisect_left(found.vocabulary.tolist(), h)] == h for h in license_scan._hashed(pa.array(["four three two one"]))[1])


def against_sql(con, name, found):
    columns = sorted(found.columns)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    got = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    relation = con.sql(queries.ORACLES[name])
    place = [relation.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in place) for r in relation.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_vector_codes", "op13_license_scan"])
def test_queries_against_their_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    against_sql(con, name, queries.QUERIES[name](spark, sf))


def test_damaged_and_mixed_licences_against_sql(spark):
    mit, gpl, bsd = license_scan.TEMPLATES["mit"][3], license_scan.TEMPLATES["gpl"][3], license_scan.TEMPLATES["bsd"][1].split()
    rng = random.Random(4)
    texts = [None, "", "MIT license", mit, mit + " x " * 30 + gpl.upper(), " ".join(bsd[:25] + ["zz"] * 30 + bsd[25:]), " ".join(bsd[:25] + ["zz"] * 60 + bsd[25:]), "é " + gpl[:200], " ".join(reversed(bsd)), (" ".join(bsd[:12]) + " ") * 3 + " ".join(bsd)]
    for text in (mit, gpl, " ".join(bsd)):
        for _ in range(4):
            w = text.split()
            for k in rng.sample(range(len(w)), rng.randint(1, 8)):
                w[k] = rng.choice(["other", "the", "license"])
            texts.append(" ".join(w[rng.randrange(10) :]))
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(range(len(texts))), "text": texts}))
    against_sql(con, "op13_license_scan", license_scan.scan_licenses(rows(spark, texts)).drop("spans"))
