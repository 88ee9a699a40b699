from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from propval.llm import merkle
from tests.llm.helpers import SCHEMA, documents

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
NAMES = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(row) -> str:
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(said(row[c]) for c in NAMES))


def tree(nodes):
    """Root and, for each node, its siblings with their side."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, a in enumerate(at):
            paths[k].append((level[a ^ 1], a % 2 == 1) if a ^ 1 < len(level) else None)
        at = [a // 2 for a in at]
        level = [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return level[0], paths


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append(r)
    groups = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    placed = {g: sorted(by[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r))) for g in groups}
    trees = {g: tree([leaf_of(r) for r in placed[g]]) for g in groups}
    root, upper = tree([trees[g][0] for g in groups])
    out = []
    for g, up in zip(groups, upper, strict=True):
        for r, path in zip(placed[g], trees[g][1], strict=True):
            path = path + up
            start = leaf_of(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None:
                start = leaf_of({**r, "n_chars": r["n_chars"] + 1})
            fold = start
            for s in path:
                fold = sha(fold) if s is None else sha(s[0] + fold) if s[1] else sha(fold + s[0])
            out.append((r["doc_id"], leaf_of(r), trees[g][0], root, sha("".join(s[0] for s in path if s)), fold, fold == root))
    return out


def got(docs, depth):
    rows = merkle.verified(merkle.manifest(docs, carried={"tampered": merkle.tampered_leaf()}, depth=depth))
    return [tuple(r) for r in rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


key = lambda r: tuple(str(x) for x in r)


@pytest.mark.parametrize("depth", [1, 2, 5, 10])
def test_equals_brute_force(spark, depth):
    rows = [(i * 3, f"text {i}", lang, "s", i if i % 5 else None) for lang, n in (("a", 1), ("b", 2), ("c", 8), ("d", 9), ("e", 67), (None, 5)) for i in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    found = got(docs, depth)
    assert sorted(found, key=key) == sorted(brute([r.asDict() for r in docs.collect()]), key=key)
    assert {r[-1] for r in found} == {True, False}


def test_odd_rows(spark):
    docs = documents(spark)
    assert sorted(got(docs, 10), key=key) == sorted(brute([r.asDict() for r in docs.select(*NAMES).collect()]), key=key)
    assert got(docs.limit(0), 10) == []
    one = docs.where("doc_id = 7")
    (r,) = got(one, 10)
    assert r[1] == r[2] == r[3] and r[4] == sha("")


def test_one_id_for_many_rows_and_a_hot_group(spark):
    rows = [(1, "same", "a", "s", 4)] * 300 + [(i, "t", "b", "s", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert sorted(got(docs, 4), key=key) == sorted(brute([r.asDict() for r in docs.collect()]), key=key)


def test_any_change_breaks_the_root(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "a", "s", i) for i in range(20)], SCHEMA)
    roots = {got(d, 3)[0][3] for d in (docs, docs.withColumn("text", F.when(F.col("doc_id") == 3, "x").otherwise(F.col("text"))), docs.where("doc_id <> 5"))}
    assert len(roots) == 3
