from __future__ import annotations

import random

import numpy as np

from propval.llm import minhash
from tests.llm.helpers import SCHEMA, documents, low, words

SF = "/root/testdata/sf0.001"


def brute_classes(rows):
    sets = {}
    for i, text in rows:
        w = words(low(text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_classes_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_classes([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()} == want


def test_star_of_variants_is_one_class(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base), "en", "a", 1)]
    for i in range(1, 60):  # each near the base, but not all near each other
        v = list(base)
        for k in rng.sample(range(0, 200, 10), 4):
            v[k] = f"v{i}_{k}"
        rows.append((i, " ".join(v), "en", "a", 1))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_classes([(r[0], r[1]) for r in rows])


def test_light_and_heavy_edits_of_one_original(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base)]
    for i in range(1, 181):  # the heavily edited match the original alone
        v = list(base)
        for k in rng.sample(range(5, 395, 10), 2 if i <= 120 else 8):
            v[k] = f"v{i}_{k}"
        texts.append(" ".join(v))
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_classes([(r[0], r[1]) for r in rows]) and set(got.values()) == {0}


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    e = np.unique(rng.integers(0, 2**62, 400).astype(np.uint64))
    x, y = rng.integers(1, 6, len(e)).astype(float), rng.integers(1, 6, len(e)).astype(float)
    k = 2000
    sig = minhash.signatures(np.concatenate([e, e]), np.concatenate([x, y]), np.repeat([0, 1], len(e)), 2, k)
    assert (sig != np.iinfo(np.uint64).max).all()
    assert abs((sig[0] == sig[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.04


def test_signature_does_not_depend_on_the_batch():
    a, b = (np.arange(s, s + 300, dtype=np.uint64) * np.uint64(77777) for s in (0, 5000))
    both = minhash.signatures(np.concatenate([a, b]), np.ones(600), np.repeat([0, 1], 300), 2)
    assert (both[0] == minhash.signatures(a, np.ones(300), np.zeros(300, dtype=int), 1)[0]).all()


def test_counts_as_weights(spark):
    one = "a b c d e f g h i j"
    rows = [(1, one, "", "", 0), (2, one + " " + one, "", "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.class_id for r in minhash.near_duplicates(df, weighting="count").collect()} == {1, 2}


def test_components(spark):
    e = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 140)]
    got = {r.node: r.root for r in minhash.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[k] == 100 for k in range(101, 140))


def test_odd_rows_and_empty_table(spark):
    docs = documents(spark)
    got = [(r.doc_id, r.class_id) for r in minhash.near_duplicates(docs).collect()]
    assert len(got) == docs.count() and got.count((1, 1)) == 2 and (3, 3) in got and (None, None) in got
    first = minhash.first_of_each(docs)
    assert first.columns == docs.columns and first.where("doc_id = 1").count() == 1 and first.count() == docs.count() - 1
    assert minhash.near_duplicates(docs.limit(0)).count() == 0 and minhash.first_of_each(docs.limit(0)).count() == 0


def pairs_with_boilerplate(n, own, shared, seed):
    """n pairs of texts: those of a pair just alike enough, texts of different pairs alike by their boilerplate."""
    rng = random.Random(seed)
    plate = " ".join(f"p{k}" for k in range(shared))
    places = range(5, own - 4, 5)
    changes = min((own + shared - 4) // 45, len(places))  # each changes five shingles of s: J = (s - 5c) / (s + 5c)
    rows = []
    for i in range(n):
        a = [f"u{i}_{k}" for k in range(own)]
        b = list(a)
        for k in rng.sample(places, changes):
            b[k] = f"v{i}_{k}"
        rows += [(2 * i, " ".join(a) + " " + plate, "en", "a", 1), (2 * i + 1, " ".join(b) + " " + plate, "en", "a", 1)]
    return rows


def exact_classes(rows):
    """brute_classes by an index of shingles, counting shared ones for every pair."""
    sets, sharing = {}, {}
    for i, text, *_ in rows:
        w = text.split()
        sets[i] = {hash(tuple(w[k : k + 5])) for k in range(len(w) - 4)}
    vocabulary = {x: k for k, x in enumerate(sorted(set().union(*sets.values())))}
    m = np.zeros((len(rows), len(vocabulary)), dtype=np.float32)
    for r, (i, *_) in enumerate(rows):
        m[r, [vocabulary[x] for x in sets[i]]] = 1
    shared, size = m @ m.T, m.sum(axis=1)
    a, b = np.nonzero(shared / (size[:, None] + size[None, :] - shared) >= 0.8)
    merged = minhash.joined(np.array([r[0] for r in rows]), a, b)
    return {r[0]: merged.get(r[0], r[0]) for r in rows}


def test_crowded_buckets_lose_no_link(spark):
    for shared in (80, 240, 700):  # cross-pair similarity from far below to just below the threshold
        own = 100
        rows = pairs_with_boilerplate(400, own, shared, shared)
        want = exact_classes(rows)
        got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
        linked = sum(want[2 * i] == want[2 * i + 1] for i in range(400))
        assert linked == 400
        assert got == want


def test_blocks_of_open_buckets_meet(spark, monkeypatch):
    monkeypatch.setattr(minhash, "OPEN_ROWS", 8)  # many blocks, large components among them
    rng = random.Random(3)
    base = [f"w{i}" for i in range(400)]
    rows = pairs_with_boilerplate(60, 100, 240, 9)
    for i in range(1000, 1120):
        v = list(base)
        for k in rng.sample(range(5, 395, 10), 2 if i < 1060 else 8):
            v[k] = f"v{i}_{k}"
        rows.append((i, " ".join(v), "en", "a", 1))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == exact_classes(rows)


def test_shared_counts_equal_sets():
    rng = np.random.default_rng(4)
    sets = [set(rng.integers(0, 60, rng.integers(1, 50)).tolist()) | set(range(1000, 1000 + i % 3)) for i in range(70)]
    where = np.repeat(np.arange(70), [len(s) for s in sets])
    elems = np.concatenate([sorted(s) for s in sets])
    left, right = np.arange(0, 40), np.arange(40, 70)
    for a, b in ((left, right), (left, left)):
        want = np.array([[len(sets[x] & sets[y]) if x != y else 0 for y in b] for x in a])
        assert (minhash.shared_counts(where, elems, a, b) * (a[:, None] != b) == want).all()
