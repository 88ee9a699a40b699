from __future__ import annotations

from collections import Counter

from propval.llm import mixing
from tests.llm.helpers import documents, words

SF = "/root/testdata/sf0.001"


def test_targets_share_all_and_respect_the_cap():
    sizes, weights = [100, 10, 1000, 0], [5.0, 2.0, 1.0, 5.0]
    t = mixing.targets(sizes, weights)
    assert abs(sum(t) - 1110) < 1e-9 and all(x <= 3 * s + 1e-9 for x, s in zip(t, sizes)) and t[3] == 0
    assert t[0] == 300 and t[1] == 30
    assert mixing.targets([], []) == []


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 64, 1000):
        got = [r.p for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(9)).alias("p")).collect()]
        assert sorted(got) == list(range(n))


def test_taken_words_come_near_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.taken(docs).collect()
    size = {r.doc_id: len(words(r.text)) for r in docs.collect()}
    assert all(r["size"] == size[r.doc_id] and r.taken <= 3 * r["size"] for r in rows) and len(rows) == len(size)
    by = {}
    for r in rows:
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert abs(sum(t for t, _ in by.values()) - sum(size.values())) < 1e-6
    assert all(abs(k - t) <= 1.5 * mixing.BLOCK_WORDS for t, k in by.values())
    again = {(r.doc_id, r.taken) for r in mixing.taken(docs).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def test_mixture_equals_brute_force_over_slots(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = mixing.sized(docs)
    sources = mixing.sources_of(sizes)
    rows = mixing.placed(sizes, sources)
    drawn = mixing.slots(sources).collect()
    slots = [(r.source_no, r.block) for r in drawn]
    held = Counter((r.shard, r.source_no) for r in drawn)
    assert held == {(r.shard, r.source_no): r.n for r in mixing.shard_counts(sources).collect()}
    for shard, n in Counter(r.shard for r in drawn).items():  # a shard's places are filled once each
        assert sorted(r.position for r in drawn if r.shard == shard) == list(range(n))
    of = {r.source_no: r for r in sources.collect()}
    for s, r in of.items():  # whole passes take every block equally often
        n = Counter(b for k, b in slots if k == s)
        assert sum(n.values()) == r.slots and (not n or max(n.values()) - min([n[b] for b in range(r.blocks)]) <= 1)
    take = Counter()
    spans = sorted((r.source_no, r.start, r["size"], r.doc_id) for r in rows.collect() if r["size"])
    for s in of:
        at = 0
        for _, start, size, _ in (x for x in spans if x[0] == s):
            assert start == at
            at += size
    for s, b in slots:
        for k, start, size, doc in spans:
            if k == s:
                take[doc] += max(0, min(start + size, (b + 1) * mixing.BLOCK_WORDS) - max(start, b * mixing.BLOCK_WORDS))
    assert {r.doc_id: r.taken for r in mixing.taken(docs).collect()} == {d: take[d] for d in (r.doc_id for r in docs.collect())}


def test_counts_of_a_shard_are_multinomial(spark):
    plan = [(f"s{i}", i, 100, 1, 1.0, 50, n, 20) for i, n in enumerate((40_000, 10_000, 2_000))]
    sources = spark.createDataFrame(plan, "source string, source_no int, source_size long, docs long, target double, blocks long, slots long, shards long")
    got = mixing.shard_counts(sources).collect()
    for _, no, *_, n, shards in plan:
        mine = [r.n for r in got if r.source_no == no]
        assert sum(mine) == n
        chi = sum((x - n / shards) ** 2 / (n / shards) for x in mine)
        assert 5 < chi < 45  # 19 degrees of freedom: neither equal shares nor uneven ones


def test_blocks_are_packed_and_shards_ordered(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 64)
    monkeypatch.setattr(mixing.sources_of, "__defaults__", (3.0, mixing.BLOCK_WORDS, 10_000, 64))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    blocks = mixing.packed(docs).collect()
    sizes = Counter()
    for r in blocks:
        assert r.n_words == len(words(r.text)) <= mixing.BLOCK_WORDS
        sizes[r.source] += r.n_words < mixing.BLOCK_WORDS
    assert max(sizes.values()) <= 3  # a source's last block, once a pass
    assert len({(r.shard, r.position) for r in blocks}) == len(blocks) and len({r.shard for r in blocks}) > 3
    total = Counter()
    for r in blocks:
        total[r.source] += r.n_words
    want = Counter()
    for r in mixing.taken(docs).collect():
        want[r.source] += r.taken
    assert total == +want
    # the mixture's rows hold the same words, block after block
    text = " ".join(" ".join(words(r.text)) for r in sorted(blocks, key=lambda r: (r.shard, r.position)))
    by = mixing._fragments_of_texts(docs, "doc_id", "source", "text", mixing.BLOCK_WORDS, keep=True).collect()
    assert " ".join(" ".join(words(r.text)) for r in sorted(by, key=lambda r: (r.shard, r.position, r.start))) == text
    assert "SHARD" in mixing.mixed(docs)._jdf.queryExecution().optimizedPlan().toString().upper()


def test_mixed_documents_hold_the_taken_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = Counter()
    for r in mixing.mixed(docs).collect():
        n[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
    assert {d: n[d] for d in n} == {r.doc_id: r.taken for r in mixing.taken(docs).collect() if r.taken}


def test_odd_rows_and_empty_table(spark):
    docs = documents(spark)
    assert mixing.taken(docs).count() == docs.count()
    n = {r.source: r for r in mixing.taken(docs).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()}
    assert all(abs(r[1] - r[2]) < 200 or abs(r[2] - r[1]) < 200 for r in n.values())
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.where("doc_id IN (2, 3, 4)").count() == 0
    assert mixing.taken(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0
