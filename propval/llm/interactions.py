"""How filters interact: what each removes, alone and after the others, in every order of a set of filters.

Each document becomes a mask, one bit a filter it fails. Documents are counted by mask, part and label flags, which leaves at
most 2^filters x 4 cells a part; all that follows works on cells. Cells are unpivoted to one row a filter and joined with the
steps at which each order applies that filter. A running bit-or over an order's steps tells whether an earlier filter removed the
cell, conditional sums count its documents, and a window over all orders gives each filter's total.

Duplicates are found without a join: rows are counted by text digest and cell, with the rows at the smallest id kept apart, so
that even a text that makes a third of all rows is only counted; a digest then has a row for each of its cells.

Null texts are empty and fail A alone, and E where a smaller id is empty too. A null id is not smaller than any and has none smaller. Repeated rows
count each; rows of the same smallest id are not duplicates of each other. A null part is the empty string. Labels of a document that is
labelled more than once count if any row says 1. An empty table has no parts and so no rows. Only the named columns are read.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from propval.llm.text import words
from propval.session import literal_table

#: The filters, in the order of their bits.
FILTERS = "ABCDE"


def failures(text: Column, words_: Column) -> dict[str, Column]:
    """Which of the filters that need only the text it fails. words_: a column of its words."""
    t, n = F.coalesce(text, F.lit("")), F.size(words_)
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words_)) < 80 * n,
        "C": 100 * F.length(F.regexp_replace(t, "[^A-Z]+", "")) > 10 * F.length(t),
        "D": t.rlike("[#$%&*|]"),
    }


def bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def masked(docs: DataFrame, part: str = "lang", id_: str = "doc_id", text: str = "text") -> DataFrame:
    """id, part, mask of the filters that need only the text, digest of the text."""
    worded = docs.select(F.col(id_).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"), words(F.col(text)).alias("words"))
    mask = sum((F.when(failed, bit(name)).otherwise(0) for name, failed in failures(F.col("text"), F.col("words")).items()), F.lit(0))
    return worded.select("id", "part", mask.alias("mask"), F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("digest"))


def cells(masks: DataFrame, labels: DataFrame, id_: str = "doc_id") -> DataFrame:
    """part, mask (with the bit of E), good, toxic, n: how many documents each cell has."""
    flags = labels.where(F.col(id_).isNotNull()).groupBy(F.col(id_).alias("of")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = masks.join(flags, masks["id"] == flags["of"], "left")
    false = F.lit(False)
    key = ["digest", "part", "mask", "good", "toxic"]
    known = known.withColumns({"good": F.coalesce("good", false), "toxic": F.coalesce("toxic", false)})
    rows = known.groupBy("id", *key).agg(F.count(F.lit(1)).alias("n"))
    alike = rows.groupBy(*key).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"),
    )
    smallest = F.min("first.id").over(W.partitionBy("digest"))
    original = F.col("no_id") + F.when(F.col("first.id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    split = alike.withColumn("smallest", smallest).withColumn("own", original)
    both = F.array(F.struct(F.col("mask").alias("mask"), F.col("own").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(bit("E"))).alias("mask"), (F.col("n") - F.col("own")).alias("n")))
    return split.select("part", "good", "toxic", F.inline(both)).where("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def steps(spark) -> DataFrame:
    """filter_order, step (from 1) and its filter, for every order."""
    return literal_table(spark, [("".join(o), k + 1, f) for o in itertools.permutations(FILTERS) for k, f in enumerate(o)], "filter_order string, step int, filter string")


def audit(counted: DataFrame) -> DataFrame:
    """For each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    wide = counted.withColumns({f: F.col("mask").bitwiseAND(F.lit(bit(f))) for f in FILTERS})
    long = wide.unpivot(["part", "mask", "good", "toxic", "n"], list(FILTERS), "filter", "failed")
    tried = long.join(F.broadcast(steps(counted.sparkSession)), "filter")  # filters x their orders: 600 rows
    at = W.partitionBy("part", "mask", "good", "toxic", "filter_order").orderBy("step")
    tried = tried.withColumns(
        {"before": F.coalesce(F.bit_or("failed").over(at.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "now": F.bit_or("failed").over(at.rowsBetween(W.unboundedPreceding, 0))}
    )
    fails, gone = F.col("failed") != 0, F.col("before") != 0
    count = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")
    stepped = tried.groupBy("part", "filter_order", "step", "filter").agg(
        count(F.col("now") == 0).alias("kept"),
        count(fails & ~gone).alias("removed"),
        count(fails & gone).alias("redundant"),
        count(fails & (F.col("mask") == F.col("failed"))).alias("unique_fails"),
        count(fails & ~gone & F.col("good")).alias("good_lost"),
        count(fails & ~gone & F.col("toxic")).alias("toxic_lost"),
    )
    return stepped.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "filter"))).drop("filter")
