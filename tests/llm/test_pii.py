from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from propval.llm import pii, queries
from tests.llm.helpers import documents

SF = "/root/testdata/sf0.01"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d: str) -> bool:
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text or "", re.ASCII):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def base_of(spark, texts):
    rows = pii.spotted(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).select("id", F.transform("base", lambda x: F.struct(x["start"], x["kind"], x["end"])).alias("b")).collect()
    return {r["id"]: [tuple(x) for x in r["b"]] for r in rows}


def test_base_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: [tuple(x) for x in r["base_spans"]] for r in pii.found(docs.select("doc_id", "text")).collect()}
    assert got == {i: brute(t) for i, t in texts.items()} and sum(map(len, got.values())) > 20


HARD = [
    "a@b.c_x@d.e f@g.h.i.", "..a@b.c..", "a@b", "@b.c", "x@y.z@u.v w@-.-", "a%b+c@d-e.f-g.h\nz@z.z", "é@b.cc ü.a@b.cc日a@b.c",
    "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256 0001.02.3.255", "1.2.3", "99999999999.1.2.3", "1.2.3.4x5.6.7.8", "1..2.3.4.5",
    "4111111111111111", "4111-1111 1111-1111", "4111  1111 1111 1111", "41111111 11111111 2", "12", "0" * 12, "0" * 19, "0" * 20, "4111\n1111 1111 1111",
    "+1 (017) 555-7713", "+1 2", "++1 234 567 890", "+1+2345678901", "+12 345 678 901 234 567", "+49.30.123456)", "+1 (555) 123-4567 +44 20 7946 0958", "",
    "😀 a@b.cc 😀😀 1.2.3.4 😀 +1 234 567 89 0", "mail: a@b.cc, 1.2.3.4; 4111111111111111",
]


def test_base_equals_brute_force_on_hard_texts(spark):
    rng = np.random.default_rng(5)
    texts = HARD + ["".join(rng.choice(list("a1.@+ -()é\n25"), 120)) for _ in range(300)] + ["".join(rng.choice(list("0123456789 -."), 80)) for _ in range(300)]
    assert base_of(spark, texts) == {i: brute(t) for i, t in enumerate(texts)}


def test_very_long_runs(spark):
    texts = ["x" * 300_000, "7" * 300_000, "1 " * 150_000, "a@" + "b." * 150_000 + "c", "+1" + "()" * 150_000, "1.2.3.4 a@b.cc " * 10_000]
    got = base_of(spark, texts)
    assert [len(got[i]) for i in range(6)] == [0, 0, 0, 1, 0, 20_000]
    assert got[5][-1] == (149_999 - 6, 0, 149_999)


def test_scan_is_the_running_sum(spark):
    for n in (0, 1, 2, 3, 7, 8, 9, 100):
        a = list(range(1, n + 1))
        df = spark.createDataFrame([(a,)], "a array<int>")
        assert df.select(pii.scan(F.col("a"), lambda x, y: x + y, 0)).first()[0] == list(np.cumsum(a))
        assert df.select(pii.scan(F.reverse("a"), F.greatest, -1)).first()[0] == [n] * n


def test_free_spans_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    for _ in range(15):
        make = lambda n: sorted((int(s), int(s + rng.integers(1, 6))) for s in rng.integers(0, 60, n))
        a, b = make(5), make(8)
        df = spark.createDataFrame([(a, b)], "a array<struct<start:int,end:int>>, b array<struct<start:int,end:int>>")
        got = [tuple(x) for x in df.select(pii.free(F.col("a"), F.col("b"))).first()[0]]
        assert got == [y for y in b if not any(x[0] < y[1] and y[0] < x[1] for x in a)]


def corpus(spark):
    """Texts with announced national numbers and written-out addresses, and with other numbers."""
    rng = np.random.default_rng(1)
    rows = []
    n = lambda *of: "".join(str(rng.integers(2, 10)) for _ in range(of[0]))
    for i in range(120):
        rows.append((f"Please call ({n(3)}) {n(3)}-{n(4)} today", "phone"))
        rows.append((f"my phone: {n(3)}-{n(3)}-{n(4)}", "phone"))
        rows.append((f"write to user{i} (at) mail{i} (dot) com", "email"))
        rows.append((f"total $ {n(3)} {n(3)} {n(3)} paid", None))
        rows.append((f"version {n(4)}-{n(4)}-{n(4)}", None))
        rows.append((f"order no. {n(16)} was sent", None))
        rows.append((f"reach me: +1 ({n(3)}) {n(3)}-{n(4)} or me{i}@example.com", "both"))
        rows.append(("look at the words dot the page", None))
    return [(k, t, w) for k, (t, w) in enumerate(rows)]


def test_learned_spans(spark):
    rows = corpus(spark)
    got = {r["id"]: [pii.KINDS[x["kind"]] for x in r["spans"] if x not in r["base_spans"]] for r in pii.found(spark.createDataFrame([r[:2] for r in rows], "id long, text string")).collect()}
    luck = {i for i, t, w in rows if w is None and brute(t)}
    right = lambda w: np.mean([(got[i] == [w]) for i, _, x in rows if x == w])
    assert right("phone") >= 0.95 and right("email") >= 0.95
    assert np.mean([not got[i] for i, _, w in rows if w is None and i not in luck]) >= 0.99
    assert all(not got[i] for i, _, w in rows if w == "both")


def test_em_weighs_labelers_and_the_classifier_follows(spark):
    spans = pii.spotted(spark.createDataFrame([(t,) for _, t, _ in corpus(spark)], "text string"))
    model = pii.learn(spans)
    phone = model["labelers"][pii.PHONE]["weights"]
    j = pii.LABELERS.index("form")
    assert phone[j][0] < 0 < phone[j][2]
    # the classifier's weights minimise the penalised loss over the same spans
    each = spans.select(F.explode(F.concat("base", "loose")).alias("x")).select(F.col("x.kind").alias("k"), F.col("x.votes").alias("votes"), pii.features(F.col("x")).alias("f"))
    posterior = F.lit(0.0)
    for k, m in enumerate(model["labelers"]):
        posterior = F.when(F.col("k") == k, pii.quality.posterior(m)).otherwise(posterior)
    data = each.select("f", posterior.alias("p")).collect()
    x, p = np.array([r["f"] for r in data]), np.array([r["p"] for r in data])
    w = np.array(model["weights"])
    prior = np.array([pii.PRIOR_BIAS] * 4 + [pii.PRIOR_FOR, pii.PRIOR_AGAINST] * 5 + [0.0] * 3)
    gradient = x.T @ (1 / (1 + np.exp(-x @ w)) - p) + pii.PRIOR_STRENGTH * (w - prior)
    assert np.max(np.abs(gradient)) < 1e-4


def test_query_and_odd_rows(spark):
    rows = queries.op13_pii(spark, SF).collect()
    assert len(rows) == 1000
    for r in rows:
        assert r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] <= (len(r["spans"].split(",")) if r["spans"] else 0)
    docs = documents(spark)
    got = pii.found(docs)
    assert got.count() == docs.count() and {r["base_spans"].__len__() for r in got.select("base_spans").collect()} == {0}
    assert got.where("`c.d` = 'own' AND `a``b` = 'own'").count() == docs.count()
    assert pii.found(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", [None, "", "plain words only", "it was 1999, page 12, section 3.4.5", "CC BY-NC 4.0 version 2.0"])
def test_clean_texts_have_no_spans(spark, text):
    rows = spark.createDataFrame([(text,)], "text string")
    assert pii.found(rows).first()["spans"] == []
