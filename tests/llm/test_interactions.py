from __future__ import annotations

import itertools
import re

from propval.llm import interactions
from tests.llm.helpers import SCHEMA, documents, words

LABELS = "doc_id long, quality int, toxic int"


def fails_of(rows):
    """(part, failed filters, row) of each document."""
    for r in rows:
        t, w = r["text"] or "", words(r["text"])
        f = "A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t)) + "D" * bool(re.search("[#$%&*|]", t))
        same = [o["doc_id"] for o in rows if (o["text"] or "") == t and o["doc_id"] is not None]
        yield r["lang"] or "", f + "E" * (r["doc_id"] is not None and min(same, default=r["doc_id"]) < r["doc_id"]), r


def brute(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    docs = list(fails_of(rows))
    out, total = {}, {}
    for part in {p for p, *_ in docs}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [(f, r["doc_id"]) for p, f, r in docs if p == part]
            all_ = left
            for k, x in enumerate(order):
                gone, left = [d for d in left if x in d[0]], [d for d in left if x not in d[0]]
                failing = sum(x in f for f, _ in all_)
                out[part, order, k + 1] = [len(left), len(gone), failing - len(gone), sum(f == x for f, _ in all_), sum(i in good for _, i in gone), sum(i in toxic for _, i in gone)]
                total[part, x] = total.get((part, x), 0) + len(gone)
    return {(p, o, k, *v, total[p, o[k - 1]]) for (p, o, k), v in out.items()}


def got(docs, labels):
    return {tuple(r) for r in interactions.audit(interactions.cells(interactions.masked(docs), labels)).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()}


def test_odd_rows_equal_brute_force(spark):
    labels = [(1, 1, 0), (2, 0, 1), (3, None, None), (6, 1, 1), (6, 0, 0), (None, 1, 1), (99, 1, 1)]
    docs = documents(spark)
    found = got(docs, spark.createDataFrame(labels, LABELS))
    assert found == brute([r.asDict() for r in docs.select("doc_id", "text", "lang").collect()], labels)
    assert len(found) == 600 * 4  # de, en, fr and the empty part
    assert got(docs.limit(0), spark.createDataFrame([], LABELS)) == set()


def test_every_mask_equals_brute_force(spark):
    w = [f"w{i}" for i in range(150)]
    texts = [" ".join(w[:n] * k) + c + d for n, k in ((150, 1), (50, 1), (60, 2), (20, 2)) for c in ("", " " + "A" * 200) for d in ("", " #")]
    rows = [(i * 10 + k, t, "ab"[i % 2], "s", 1) for i, t in enumerate(texts) for k in range(1 + i % 3)]
    rows += [(rows[0][0], rows[0][1], "b", "s", 1)] * 2 + [(None, texts[0], "a", "s", 1), (5000, texts[0], None, "s", 1)]
    labels = [(r[0], i % 2, i % 3 == 0) for i, r in enumerate(rows) if r[0] is not None and r[0] != rows[0][0]]
    labels = [(i, q, int(t)) for i, q, t in labels]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(docs, spark.createDataFrame(labels, LABELS)) == brute([r.asDict() for r in docs.collect()], labels)


def test_a_hot_text_is_only_counted(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'same', concat('t', id)) AS text", "'en' AS lang")
    cells = interactions.cells(interactions.masked(docs), spark.createDataFrame([], LABELS)).collect()
    assert {(r["mask"], r["n"]) for r in cells} == {(1, 2001), (17, 999)}
    plan = interactions.cells(interactions.masked(docs), spark.createDataFrame([], LABELS))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # the labels'
