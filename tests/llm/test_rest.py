from __future__ import annotations

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from propval.llm import chat, katz, licenses, queries, sentencepiece_viterbi as sp, topk, toxicity, urls
from tests.llm.helpers import ODD, SCHEMA, documents, low, words
from tests.oracle_check import differences, views

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    assert differences(queries.queries()[name](spark, SF), views(SF), queries.oracle_sql()[name]) == ""


# toxicity ---------------------------------------------------------------------------------------------


def test_held_out_toxicity(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels.where("doc_id % 4 <> 0"))
    assert np.all(np.diff(model.thetas) > 0) and len(model.thetas) == 2
    got = toxicity.scored(docs, model, prefix="p_").join(labels.where("doc_id % 4 = 0"), "doc_id").select("toxic", "p_toxic", "p_severity").collect()
    hit = sum(r.toxic == 1 and r.p_toxic for r in got)
    assert hit >= 0.8 * sum(r.toxic for r in got) and hit >= 0.97 * sum(r.p_toxic for r in got)


def test_small_language_has_telling_words():
    # word 3 is in 6 toxic texts, all of the small language: too few among all texts
    rows = [np.array([1, 10 + i % 7]) for i in range(1000)] + [np.array([2, 10 + i % 7]) for i in range(1400)]
    small = [np.array([3, 30 + i % 3]) for i in range(6)] + [np.array([40 + i % 3]) for i in range(34)]
    toxic = np.array([True] * 1000 + [False] * 1400 + [True] * 6 + [False] * 34)
    langs = np.array(["en"] * 2400 + ["es"] * 40)
    assert 3 not in toxicity.telling(rows + small, toxic)[0] and 3 in toxicity.telling_by(rows + small, toxic, langs)[0]
    score = lambda m: sum(w for f, w in zip(m.features, m.weights, strict=True) if f == 3)
    assert score(toxicity.fit(rows + small, toxic.astype(int), langs=langs)) > 0


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for i in range(600):
        g = i % 3
        rows.append(np.unique(np.concatenate([rng.integers(100, 400, 20), np.arange(g * 3)])))
        y.append(g)
    m = toxicity.fit(rows, np.array(y))
    place = dict(zip(m.features.tolist(), m.weights))
    s = np.array([sum(place.get(int(b), 0.0) for b in r) for r in rows])
    sev = m.above(s).sum(axis=1)
    assert [round(float(sev[np.array(y) == g].mean())) for g in range(3)] == [0, 1, 2]


def test_fit_equals_an_independent_optimiser():
    rng = np.random.default_rng(11)
    rows, y = [], []
    for _ in range(2000):
        x = [b for b in range(5) if rng.random() < 0.4]
        s = sum(w for b, w in enumerate((2.0, 1.5, -1.5, 2.5, 1.0)) if b in x) + rng.logistic()
        rows.append(np.array(x, dtype=np.int64))
        y.append(int(s > 1) + int(s > 3))
    y = np.array(y)
    m = toxicity.fit(rows, y, rounds=4000)
    x = np.array([[f in r for f in m.features.tolist()] for r in rows], dtype=float)
    n = len(m.features)
    assert n >= 3
    sig = lambda z: 1 / (1 + np.exp(-z))

    def loss(v):
        score, theta = x @ v[:n], v[n:]
        at = np.column_stack([np.zeros(len(y)), *(sig(t - score) for t in theta), np.ones(len(y))])
        p = at[np.arange(len(y)), y + 1] - at[np.arange(len(y)), y]
        return -np.log(p).mean() + toxicity.L2 * (v[:n] ** 2).sum() / 2 / len(y)

    v, h = np.concatenate([np.zeros(n), [0.0, 2.0]]), 1e-4  # Newton's method on numerical derivatives
    eye = np.eye(len(v)) * h
    for _ in range(30):
        g = np.array([(loss(v + e) - loss(v - e)) / (2 * h) for e in eye])
        hess = np.array([[(loss(v + a + b) - loss(v + a - b) - loss(v - a + b) + loss(v - a - b)) / (4 * h * h) for b in eye] for a in eye])
        v = v - np.linalg.solve(hess + 1e-9 * np.eye(len(v)), g)
    assert np.allclose(m.weights, v[:n], atol=2e-2) and np.allclose(m.thetas, v[n:], atol=2e-2)


def test_toxicity_scores_equal_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    weight = dict(zip(model.features.tolist(), model.weights.tolist()))
    assert weight
    for r in toxicity.scored(docs, model).collect():
        found = set()
        for w in (r.text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" "):
            if w := low(w).strip(toxicity.EDGES.decode()):
                found.add(zlib.crc32(w.encode()) % toxicity.BUCKETS)
        s = sum(weight.get(b, 0.0) for b in found)
        above = [1 / (1 + math.exp(min(500, max(-500, t - s)))) for t in model.thetas]
        assert abs(r.severity - sum(above)) < 1e-9 and abs(r.p_toxic - above[0]) < 1e-9
        assert r.toxic == (above[0] >= 0.5 and bool(words(r.text)))


def test_labels_of_absent_documents_do_not_use_up_the_sample(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    present = labels.join(docs.where("text IS NOT NULL"), "doc_id", "left_semi").count()
    absent = spark.range(10_000_000, 10_050_000).selectExpr("id AS doc_id", "1 AS quality", "1 AS toxic")
    rows, y, _ = toxicity.sample(docs, labels.select("doc_id", "quality", "toxic").union(absent), max_labelled=present)
    assert len(rows) == len(y) == present
    # ids of another type, repeated rows and labels
    named = docs.limit(50).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    own = named.select("doc_id", F.lit(1).alias("toxic")).limit(20)
    assert len(toxicity.sample(named.union(named), own.union(own))[1]) == 40
    assert len(toxicity.sample(named.union(named), own, max_labelled=7)[1]) == 7


def test_toxicity_odd_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 0), (None, 1), (2, 1), (99, None)], "doc_id long, toxic int")
    out = toxicity.filtered(docs, labels)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert toxicity.filtered(docs.limit(0), labels.limit(0)).count() == 0


# top-k ------------------------------------------------------------------------------------------------


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=40)]) for i in range(300)] + [(300, [1.0] * 40), (301, [1.0] * 40), (302, None), (303, [float("nan")] * 40), (304, [None] * 40), (None, [1.0]), (305, []), (306, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = topk.usable(df)
    got = collections.defaultdict(list)
    for r in sorted(topk.top_k(v, v.where("vec_id % 50 = 0")).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    ok = {i: [math.floor(256 * float(np.float32(x))) for x in e] for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    for q in (i for i in ok if i % 50 == 0):
        want = sorted(((sum(a * b for a, b in zip(ok[q], ok[c])), -c) for c in ok if c != q), reverse=True)[:5]
        assert got[q] == [(-c, s) for s, c in want]
    assert set(got) == {i for i in ok if i % 50 == 0}
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_top_k_in_batches_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=40) * (1 + (i % 9 == 0))]) for i in range(600)] + [(600 + i, [0.5] * 40) for i in range(60)]  # many equal ones
    v = topk.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    want = sorted(tuple(r) for r in topk.top_k(v, v.where("vec_id % 50 = 0")).collect())
    monkeypatch.setattr(topk, "BLOCK_NUMBERS", 500)
    monkeypatch.setattr(topk, "QUERY_BYTES", 1000)
    assert sorted(tuple(r) for r in topk.top_k(v, v.where("vec_id % 50 = 0")).collect()) == want
    # candidates are scanned in place: the one exchange is that of the k rows a query
    monkeypatch.undo()
    assert topk.top_k(v, v.where("vec_id % 50 = 0"))._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_top_k_prunes():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 64)) * np.linspace(2, 0.2, 64)  # mass in the first dimensions
    s = topk.Search(np.arange(20), x[:20], 5)
    for at in range(0, 4000, 500):
        s.meet(np.arange(at, at + 500), x[at : at + 500])
    f = np.floor(256 * x)
    for q in range(20):
        score = (f @ f[q]).astype(np.int64)
        want = sorted((-score[i], i) for i in range(4000) if i != q)[:5]
        assert [(-b, a) for a, b in zip(*s.best[q])] == want
    assert s.done < 0.8 * s.all


def test_top_k_bars_only_prune():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 96)) * np.linspace(3, 0.3, 96)
    ids, asks = np.arange(6000), x[:40]
    plain_, seeded = topk.Search(np.arange(40), asks, 5), topk.Search(np.arange(40), asks, 5)
    first = topk.Search(np.arange(40), asks, 5)
    first.meet(ids[:1024], x[:1024])
    seeded.bars = first.reached()
    for s in (plain_, seeded):
        s.meet(ids, x)
    assert all((a[0] == b[0]).all() and (a[1] == b[1]).all() for a, b in zip(plain_.best, seeded.best, strict=True))
    assert seeded.done < plain_.done


def test_top_k_huge_components_and_other_ids(spark):
    rows = [("0", [1e18, 1.0]), ("1", [1e18, 2.0]), ("2", [-3.0, 1e17]), ("50", [2e-3, -1e300]), ("x", [1.0, 1.0]), ("3", [1.0] * 5), ("0", [1e18, 1.0])]
    v = topk.usable(spark.createDataFrame(rows, "vec_id string, embedding array<double>"))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(v, v.where("vec_id % 50 = 0")).collect()}
    top = 2**63 - 1
    fl = lambda x: math.floor(256 * x) if abs(x) < 2**50 else int(x) * 256
    exact = {}
    for i, e in rows:
        if i != "x":
            exact[int(i)] = [fl(c) for c in e]
    for q in (0, 50):
        want = sorted((-max(-(2**63), min(top, sum(a * b for a, b in zip(exact[q], exact[c])))), c) for c in exact if c != q)
        seen = [got[q, r] for r in range(1, 6) if (q, r) in got]
        assert [x for x in seen if x[0] != 0] == [(c, -s) for s, c in want if c != 0][: len([x for x in seen if x[0] != 0])] and len(seen) == (4 if q == 0 else 5)


# urls -------------------------------------------------------------------------------------------------


def test_urls_rules_and_parsing(spark):
    rows = [(1, "http://A.Example.com/en/7?x", None), (2, "https://a.example.com/en/1", None), (3, "HTTP://x.net/de/8", ""), (4, "http://m.example.net/de/81#t", None), (5, None, None), (6, "no scheme", None), (7, "ftp://x.org", None), (8, "http://notexample.com/fr", None)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[2] == ("a.example.com", "/en/1", "com/en/", "block")
    assert got[3] == ("x.net", "/de/8", "net/de/", "allow")
    assert got[4] == ("m.example.net", "/de/81", "example.net/de/8", "block")
    assert got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow") and got[7][:3] == ("x.org", "", None)


def test_trust_spreads_along_links_and_distrust_against_them(spark):
    page = lambda i, url, *to: (i, url, "".join(f'<a href="{t}">x</a>' for t in to))
    rows = [
        page(1, "http://bad.com/en/1", "http://other.io/"), page(2, "http://farm.io/a", "http://bad.com/x", "//bad.com/y"),
        page(3, "http://good.net/de/1", "http://friend.io/"), page(4, "http://friend.io/a", "http://good.net/"), page(5, "http://alone.io/"), page(6, "http://other.io/z", "/local"),
    ]
    got = {r.page_id: (r.verdict, r.trust, r.distrust) for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2][0] == "block" and got[2][2] > 0 and got[4][0] == "allow" and got[4][1] > 0 and got[5] == ("allow", 0.0, 0.0) and got[6][0] == "allow"


def test_pagerank_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    n = 12
    links = sorted({(int(a), int(b)) for a, b in rng.integers(0, n, (40, 2)) if a != b and a != 3})
    out = collections.Counter(a for a, _ in links)
    edges = spark.createDataFrame([(f"h{a}", f"h{b}", 1.0 / out[a]) for a, b in links], "src string, dst string, share double")
    seeds = spark.createDataFrame([("h0", 0.5), ("h3", 0.5)], "host string, weight double")
    s = np.zeros(n)
    s[[0, 3]] = 0.5
    r = s.copy()
    for _ in range(urls.ROUNDS):
        m = np.zeros(n)
        for a, b in links:
            m[b] += 0.85 * r[a] / out[a]
        r = m + s * (1 - m.sum())
    got = {x.host: x["rank"] for x in urls.spread(edges, seeds).collect()}
    assert all(abs(got.get(f"h{i}", 0.0) - r[i]) < 1e-9 for i in range(n))


def test_urls_repeated_rows_long_html_and_clashing_columns(spark):
    long = "x" * 2_000_000 + '<a href="http://bad.com/x">'
    rows = [(1, "http://bad.com/en/1", None), (1, "http://bad.com/en/1", None), (2, "http://farm.io/a", long), (2, "http://farm.io/a", long), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("own") for c in ("host", "path", "rule", "ruled", "src", "dst", "share", "trust", "rank", "n", "of", "to")})
    got = sorted(((r.page_id or 0, r.verdict) for r in urls.judged(pages).collect()))
    assert got == [(0, "allow"), (1, "block"), (1, "block"), (2, "block"), (2, "block")]


def test_urls_empty_table(spark):
    assert urls.judged(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# SentencePiece ----------------------------------------------------------------------------------------

TEXTS = [r[1] for r in ODD if r[1] is not None and len(r[1]) < 70000] + ["  two  spaces ", "a\n\tb\r\n", "</s> <s> <0x0A> [INST]", "ééé ½ ＡＢ", "a" * 500, "aaaa bbbb" * 50, "==========-----", "\x00\x01", "x" * 33 + "Ж" * 40, "ab" * 3000, "日本語の文章" * 300]


def test_ids_equal_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL_PATH)
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    enc = sp.encoder()
    for t in texts:
        ids = enc.encode(t).tolist()
        assert ids == lib.encode(t), t[:80]
        assert enc.decode(ids) == t


def test_window_commits_early_and_changes_nothing():
    enc = sp.encoder()
    text = "thequickbrownfoxjumpsoverthelazydog" * 200
    seen, at = [], []

    def chars():
        for i, c in enumerate(text):
            at.append(i)
            yield c

    for p in enc.pieces_of(chars()):
        seen.append((p, at[-1]))
    assert "".join(p for p, _ in seen) == text and seen[0][1] < 200
    assert [p for p, _ in seen] == enc._merged(text)


def test_every_run_of_documents_commits_within_the_window(spark):
    enc, longest = sp.Encoder(sp.PieceModel.load()), sp.PieceModel.load().longest
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text]
    for t in texts:
        enc.encode(t)
    runs = {m for t in texts for m in enc._split.findall(sp.MARK + t.replace(" ", sp.MARK))}
    assert enc.commits >= len(runs) and enc.widest <= 2 * longest  # no run was encoded without the search
    long = "".join(texts[0].split()) * 100
    before = enc.commits
    assert "".join(enc.pieces_of(long)) == long
    assert enc.commits - before > len(long) / (3 * longest) and enc.widest <= 4 * longest


def test_states_of_the_search_are_worked_out_once(spark, monkeypatch):
    enc = sp.Encoder(sp.PieceModel.load())
    made, merged = [], []
    following, merge = enc.following, enc._merged
    monkeypatch.setattr(enc, "following", lambda *a: made.append(1) or following(*a))
    monkeypatch.setattr(enc, "_merged", lambda *a: merged.append(1) or merge(*a))
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text]
    for t in texts:
        enc.encode(t)
    runs = {m for t in texts for m in enc._split.findall(sp.MARK + t.replace(" ", sp.MARK))}
    assert len(made) < sum(map(len, runs)) / 3  # each character of each run was a step of its own before
    assert len(merged) < len(enc._pairs) / 5  # each pair was merged anew before
    made.clear()
    enc._runs.clear()
    enc._runs.before = {}
    for t in reversed(texts):
        enc.encode(t)
    assert not made


def test_pairs_are_tested_as_merging_them_would():
    enc = sp.Encoder(sp.PieceModel.load())
    rng = np.random.default_rng(9)
    pieces = [p for p in enc.m.ids if len(p) > 1]
    fits = 0
    for i, j in rng.integers(0, len(pieces), (3000, 2)):
        k = int(rng.integers(1, len(pieces[i])))
        for left, right in ((pieces[i], pieces[j]), (pieces[i][:k], pieces[i][k:] + pieces[j][:1]), ("Ж" * 3, pieces[j])):
            assert enc._fits(left, right) == (enc._merged(left + right) == [left, right])
            fits += enc._fits(left, right)
    assert 500 < fits < 8500


def test_few_remembered_states_change_nothing(monkeypatch):
    usual, few = sp.encoder(), sp.Encoder(sp.PieceModel.load())
    want = [usual.encode(t).tolist() for t in TEXTS]
    monkeypatch.setattr(sp, "REMEMBERED", 20)
    for t, ids in zip(TEXTS, want, strict=True):
        assert few.encode(t).tolist() == ids
        assert max(len(few._states), len(few._pairs), len(few._alone), len(few._runs)) <= 20
        assert sum(map(len, [few._start, *few._states.values()])) <= 40
    some = [chr(c) for c in np.random.default_rng(7).choice(np.arange(0x1F300, 0x1F30F), 3000)]  # in no piece: 15 states, 225 steps between them
    assert few.encode("".join(some)).tolist() == usual.encode("".join(some)).tolist()
    assert sum(map(len, [few._start, *few._states.values()])) <= 40
    few.forget()
    assert not few._states and not few._start


def piece_model(scores):
    """A small unigram model in the library's file format."""
    import struct

    field = lambda n, b: bytes([n << 3 | 2]) + (bytes([len(b) & 127 | 128, len(b) >> 7]) if len(b) > 127 else bytes([len(b)])) + b
    out = b""
    for piece, score, kind in [("<unk>", 0.0, 2), *((p, s, 1) for p, s in scores.items())]:
        out += field(1, field(1, piece.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", score) + bytes([3 << 3, kind]))
    out += field(2, bytes([3 << 3, 1]))
    return out + field(3, field(1, b"identity") + bytes([3 << 3, 0, 4 << 3, 0]))


def test_unigram_search_maximises_the_score():
    rng = np.random.default_rng(8)
    for _ in range(30):
        scores = {"a": -3.0, "b": -3.5, sp.MARK: -2.0}
        for _ in range(12):
            scores["".join(rng.choice(list("ab"), rng.integers(2, 6)))] = -float(rng.uniform(1, 6))
        enc = sp.Encoder(sp.PieceModel(piece_model(scores)))
        text = "".join(rng.choice(list("ab "), 60))
        marked = text.replace(" ", sp.MARK)
        best = [0.0] + [-math.inf] * len(marked)
        for n in range(1, len(marked) + 1):
            best[n] = max((best[k] + scores[marked[k:n]] for k in range(max(0, n - 6), n) if marked[k:n] in scores), default=-math.inf)
        got = [enc.m.pieces[i] for i in enc.encode(text)]
        assert "".join(got) == marked and abs(sum(scores[p] for p in got) - best[-1]) < 1e-5
        assert list(enc.pieces_of(marked)) == got or abs(sum(scores[p] for p in enc.pieces_of(marked)) - best[-1]) < 1e-5


def test_encoded_and_decoded_tables(spark):
    docs = documents(spark)
    rows = sp.encoded(docs)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows.collect())
    back = sorted((r.doc_id or 0, r.text) for r in sp.decoded(rows).collect())
    assert back == sorted((r[0] or 0, r[1] or "") for r in ODD)
    assert sp.encoded(docs.limit(0)).count() == 0


# licences ---------------------------------------------------------------------------------------------


def test_licenses_found_and_clean_texts_left(spark):
    filler = " ".join(f"word{i}" for i in range(57))
    rows, want = [], set()
    for k, (name, text) in enumerate(licenses.TEMPLATES.items()):
        rows.append((k, f"{filler} {text.upper()} {filler}", "", "", 0))
        want.add((k, name))
    rows += [(100, filler, "", "", 0), (101, None, "", "", 0), (102, "Released under the", "", "", 0), (103, "Released under the MIT License.", "", "", 0)]
    got = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert want <= got and (103, "MIT") in got and not {d for d, _ in got} & {100, 101, 102}


def test_license_scan_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    clean = str.maketrans(dict.fromkeys(licenses.PUNCTUATION, " "))
    shingle = lambda t: {tuple(w[k : k + 5]) for w in [words(t.lower().translate(clean))] for k in range(len(w) - 4)}
    named = {n: shingle(t) for n, t in licenses.TEMPLATES.items()}
    want = set()
    for r in docs.collect():
        s = shingle(r.text)
        want |= {(r.doc_id, n) for n, t in named.items() if len(t & s) >= 0.8 * len(t)}
    assert {(r.doc_id, r.license) for r in licenses.scan(docs).collect()} == want


def test_short_templates_and_repeated_rows(spark):
    rows = [(1, "Some text. All rights reserved. More text here", "", "", 0)] * 2 + [(2, "all rights were reserved", "", "", 0), (3, "(c) All Rights Reserved", "", "", 0), (4, "rights reserved", "", "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in ("h", "row", "at", "w", "around", "from", "band", "value", "license", "of", "containment")})
    got = sorted((r.doc_id, r.license) for r in licenses.scan(docs, {"reserved": "All rights reserved.", "MIT": licenses.TEMPLATES["MIT"]}).collect())
    assert got == [(1, "reserved"), (1, "reserved"), (3, "reserved")]
    with pytest.raises(ValueError):
        licenses.scan(docs, {"none": "..."})


def test_hash_marks_have_no_false_negatives(spark):
    rng = np.random.default_rng(1)
    known = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 500)]
    other = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 5000)]
    mark = licenses._marked(known)
    got = {r.x: r.m for r in spark.createDataFrame([(x,) for x in known + other], "x long").select("x", mark(F.col("x")).alias("m")).collect()}
    assert all(got[x] for x in known) and sum(got[x] for x in other) < 1000


def test_license_odd_rows(spark):
    assert licenses.scan(documents(spark)).count() == 0
    assert licenses.scan(documents(spark).limit(0)).count() == 0


# chat -------------------------------------------------------------------------------------------------


def test_best_branch_is_formatted(spark):
    rows = [(1, 1, None, "user", "hi", 0.0), (1, 2, 1, "assistant", "a", 0.1), (1, 3, 1, "assistant", "b", 0.9), (1, 4, 3, "user", "c", 0.5), (1, 5, 2, "user", "d", 0.2), (2, 1, None, "user", None, None), (3, 7, 8, "user", "loop", 1.0), (3, 8, 7, "user", "loop", 1.0)]
    df = spark.createDataFrame(rows, "conv_id long, id long, parent long, role string, text string, score double")
    got = {r.conv_id: r for r in chat.formatted(df).collect()}
    assert set(got) == {1, 2} and got[1].leaf == 4 and got[1].n_turns == 3
    assert got[1].formatted == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    assert [got[1].formatted[s.start : s.start + s.length] for s in got[1].loss] == ["b"]
    both = chat.formatted(df, branches=5).where("conv_id = 1").collect()
    assert sorted((r.branch, r.leaf) for r in both) == [(1, 4), (2, 5)]


def test_control_strings_come_back(spark):
    assert "<start_of_turn>" not in spark.range(1).select(chat.escaped(F.lit("a<start_of_turn>b<|reserved_special_token_0|>"))).first()[0]
    texts = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\nx", "a\\b \\\\ <\\|im_end|>", "", "\\", "<<SYS>> </SYS>", "<start_of_turn>user<|reserved_special_token_0|> <bos>", "\n\n", None, "[INST", "<|a|><|b|>"]
    rows = [(1, i, "assistant" if i % 2 else "us\ner<|x|>", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = chat.formatted(chat.as_replies(df)).select(chat.turns_of(F.col("formatted")).alias("t"), chat.learned_text(F.col("formatted"), F.col("loss")).alias("l")).first()
    assert [(x.role, x.text) for x in r.t] == [(b, t or "") for _, _, b, t in rows]
    assert r.l == "".join(t or "" for t in texts[1::2])


def test_long_chain_and_empty(spark):
    df = spark.createDataFrame([(2, i, "assistant", "clash") for i in range(3)], "conv_id long, turn long, role string, text string")
    df = df.withColumns({c: F.lit("own") for c in ("id", "parent", "score", "up", "steps", "r_id", "r_conv", "back", "leaf", "branch", "turns", "formatted", "loss")})
    assert [(r.conv_id, r.n_turns) for r in chat.formatted(chat.as_replies(df)).collect()] == [(2, 3)]
    df = spark.createDataFrame([(1, i, "user", str(i)) for i in range(300)] + [(None, 0, None, None), (None, 0, None, None)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.n_turns for r in chat.formatted(chat.as_replies(df)).collect()}
    assert got == {1: 300, None: 2}
    assert chat.formatted(chat.as_replies(df.limit(0))).count() == 0


# language model ---------------------------------------------------------------------------------------


def brute_katz(rows):
    texts = [(i, [*words(low(t or "")), " "]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    u, b = collections.Counter(), collections.Counter()
    for i, t in texts:
        if not held(i):
            u.update(t)
            b.update(zip(["\t", *t[:-1]], t))
    total, types = sum(u.values()), len(u)
    of = lambda c: katz.discounts([0, *(sum(x == k for x in c.values()) for k in range(1, 7))])
    d1, d2 = of(u), of(b)
    dc = lambda c, d: c * (d[c] if c <= 5 else 1.0)
    kept = sum(dc(c, d1) for c in u.values())
    base = total if kept < total - 1e-9 else total + 1
    unknown = 1 - kept / base
    p1 = lambda w: dc(u[w], d1) / base if u[w] else unknown
    after = collections.defaultdict(dict)
    for (h, w), c in b.items():
        after[h][w] = c
    back = {}
    for h, m in after.items():
        n, k = sum(m.values()), sum(dc(c, d2) for c in m.values())
        n2 = n if k < n - 1e-9 else n + 1
        back[h] = (n2, (1 - k / n2) / (1 - sum(p1(w) for w in m)))
        assert abs(sum(dc(c, d2) / n2 for c in m.values()) + back[h][1] * (unknown + sum(p1(w) for w in u if w not in m)) - 1) < 1e-9
    out = []
    for i, t in texts:
        s = 0.0
        for h, w in zip(["\t", *t[:-1]], t):
            c = b.get((h, w), 0)
            s += math.log10(dc(c, d2) / back[h][0] if c else (back[h][1] if h in back else 1.0) * p1(w))
        base_score = sum(math.log10((u[w] + 0.5) / (total + 0.5 * (types + 1))) for w in t)
        out.append((i, held(i), len(t), sum(u[w] > 0 for w in t), total, round(base_score, 4), round(s, 4)))
    return sorted(out, key=str)


def scores(df, **how):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in katz.scored(df, **how).collect()), key=str)


def test_katz_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    want = brute_katz([(r.doc_id, r.text) for r in docs.collect()])
    assert scores(docs, chunk=3000, part_chars=30000) == want
    assert sum(r[6] for r in want if r[1]) > sum(r[5] for r in want if r[1])


def test_katz_stored_tables_score_new_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").select("doc_id", "text")
    model, scores_ = katz.learned(docs, chunk=3000, part_chars=30000)
    plain = lambda df: sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in df.collect()), key=str)
    assert model.parts > 2 and model.shares.count() > 0  # some histories are divided
    assert plain(katz.evaluate(docs, model, chunk=5000)) == plain(scores_)
    # texts that were not there: each scored as if held out beside the same training rows
    new = [(1_000_000 + k, t) for k, t in enumerate(["the of and to unseenword", None, docs.where("doc_id = 3").first().text, "zzz yyy"])]
    ids = [i for i in range(10**6, 10**6 + 200) if katz.held_out_of(i)]
    rows = [(i, t) for i, (_, t) in zip(ids, new)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r[0]: r[6] for r in brute_katz([*((r.doc_id, r.text) for r in docs.collect()), *rows])}
    assert {r.doc_id: round(r.score, 4) for r in katz.evaluate(df, model).collect()} == {i: want[i] for i, _ in rows}
    words_, pairs, backoffs = katz.tables(model)
    n = pairs.agg({"count": "sum"}).first()[0]
    assert n == words_.agg({"count": "sum"}).first()[0] == model.uni.total
    # each history's probabilities sum to 1: of the seen, and of the rest by backoff
    p1 = {r.word: r.p for r in words_.collect()}
    seen = collections.defaultdict(dict)
    for r in pairs.collect():
        seen[r.history][r.word] = r.p
    for r in backoffs.collect():
        rest = model.uni.unknown + sum(p for w, p in p1.items() if w not in seen[r.history])
        assert abs(sum(seen[r.history].values()) + r.backoff * rest - 1) < 1e-9


def test_katz_ids_of_any_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    named = docs.withColumn("doc_id", F.concat(F.lit("a\n\"é"), F.col("doc_id")))
    got = {r.doc_id: r for r in katz.scored(named.unionByName(named.limit(1).withColumn("doc_id", F.lit(None).cast("string")))).collect()}
    assert set(got) == {r.doc_id for r in named.collect()} | {None}
    assert all(r.held_out == (i is not None and zlib.crc32(i.encode()) % 5 == 1) for i, r in got.items()) and any(r.held_out for r in got.values())


def test_katz_odd_rows(spark):
    assert scores(documents(spark)) == brute_katz([(r[0], r[1]) for r in ODD])
    assert katz.scored(documents(spark).limit(0)).count() == 0
