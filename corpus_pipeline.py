"""The corpus pipeline: quality rules, toxicity, near-dedup, mixing to target weights, SentencePiece ids.

Every stage takes nulls in any column, empty and very long texts (read whole), repeated rows, an empty table (which gives an
empty one) and extra columns of any name, which stay as they are; each says below what becomes of them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from propval.llm import minhash, mixing, quality, sentencepiece_viterbi, toxicity
from propval.session import drop_written, table, tables_written, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: The tables that stages wrote on the way.
_SCRATCH: set[str] = set()


def scratch(stage: Stage) -> Stage:
    """The stage, which first deletes what earlier stages wrote on their way, unless docs still reads it: once a stage's rows are
    stored and read again, nothing does."""

    @functools.wraps(stage)
    def run_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles() if _SCRATCH else []
        stale = {p for p in _SCRATCH if not any(p.rsplit("/", 1)[-1] in f for f in read)}
        drop_written(spark, stale)
        _SCRATCH.difference_update(stale)
        before = tables_written()
        out = stage(spark, docs, sf_dir)
        _SCRATCH.update(tables_written() - before)
        return out

    return run_


@scratch
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the rules' joint posterior keep.

    Null and empty texts fail the base rule and go. Repeated rows are judged alike; a posterior of exactly one half keeps."""
    return quality.filtered(docs)


@scratch
def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic; the model learns from the labels of documents still there.

    Null and empty texts are never toxic; without labels of two grades none is. Repeated rows are judged alike; a probability of
    exactly one half is toxic."""
    return toxicity.filtered(docs, table(spark, sf_dir, "labels"))


@scratch
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, its smallest doc_id.

    Texts without words all stay. Of repeated rows of that id one stays (any: they are equal in id and text); a null id comes
    after all others."""
    return minhash.first_of_each(docs)


@scratch
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources at its target weights: the words that a slot's block holds of a document are a row, shard by shard.

    Texts without words are in no mixture. A null source is a source, a null id an id; of rows equal in id, source and text each
    holds its own words, and the rows carry the other columns of any one of them."""
    return mixing.mixed(docs)


@scratch
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of each row's text: doc_id, n_tokens, ids, round_trip.

    Null and empty texts have none. Repeated rows are encoded each."""
    return sentencepiece_viterbi.encoded(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs


#: The estimates of the first two stages, signatures and ids are beyond SQL; tests compare each with brute force.
ORACLE_SQL = None
