from __future__ import annotations

import collections

import corpus_pipeline
from propval.llm import mixing
from tests.llm.helpers import documents, words
from tests.llm.test_minhash import brute_classes
from propval.session import written

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, before, SF), name)
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()} and ids
        if name != "sentencepiece":
            assert docs.columns == before.columns
        if name == "quality_rules":
            assert not any(labels[i].quality == 0 for i in ids if i in labels)
        if name == "near_dedup":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert ids == set(brute_classes(rows).values())
    assert docs.where("NOT round_trip").count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (documents(spark), documents(spark).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, str(tmp_path))
            assert out.count() <= (3 * 50_000 // mixing.BLOCK_WORDS + 3 * 9 * 2 if name == "mix_sources" else rows.count()), name
            if name != "sentencepiece":
                assert out.columns == rows.columns


def test_mixture_of_the_pipeline_is_near_its_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by = collections.Counter()
    for r in corpus_pipeline.mix_sources(spark, docs, SF).collect():
        by[r.source] += len(words(r.text))
    for r in mixing.taken(docs).groupBy("source").agg({"target": "max"}).collect():
        assert abs(by[r.source] - r[1]) <= 2 * mixing.BLOCK_WORDS


def test_stages_clear_up_what_nothing_reads(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    one = corpus_pipeline.quality_rules(spark, docs, SF)
    two = corpus_pipeline.near_dedup(spark, one, SF)  # on rows not yet stored: what they read stays
    assert two.count() <= one.count()
    stored = written(two, "stored")
    n = stored.count()
    three = corpus_pipeline.mix_sources(spark, stored, SF)
    assert len(corpus_pipeline._SCRATCH) < 8 and three.count() > 0 and stored.count() == n
