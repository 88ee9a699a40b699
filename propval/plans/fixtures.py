"""The provided tables seen as sales, diagnostics, points, polygons, relations and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propval.session import table


def sale(spark: SparkSession, d: str) -> DataFrame:
    o, c, li = (table(spark, d, t) for t in ("orders", "customer", "lineitem"))
    lines = li.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("surface"), F.count(F.lit(1)).alias("rooms"))
    return (
        o.join(c, o["o_custkey"] == c["c_custkey"])
        .join(lines, o["o_orderkey"] == lines["l_orderkey"], "left")
        .select(
            F.col("o_orderkey").alias("sale_id"),
            F.col("o_orderdate").cast("date").alias("sale_date"),
            F.year("o_orderdate").alias("sale_year"),
            F.col("c_mktsegment").alias("segment"),
            F.col("c_nationkey").alias("area"),
            F.col("o_totalprice").cast("double").alias("price"),
            F.col("surface").cast("double").alias("surface"),
            F.col("rooms"),
            (F.col("o_totalprice").cast("double") / F.col("surface").cast("double")).alias("ppm2"),
            (F.col("o_custkey") * 37 % 10007).cast("double").alias("x"),
            (F.col("o_custkey") * 101 % 9973).cast("double").alias("y"),
        )
    )


def probe(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("probe_id"), F.col("user_id").alias("building"), F.col("ts").alias("probe_ts"), F.col("value").cast("double").alias("value"))


def diag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'signup'").select(F.col("event_id").alias("diag_id"), F.col("user_id").alias("building"), F.col("ts").alias("diag_ts"), F.col("value").cast("double").alias("score"))


def poi(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("poi_id"), (k % 4).alias("mode"), F.col("s_acctbal").cast("double").alias("weight"), (k * 7919 % 10007).cast("double").alias("x"), (k * 1049 % 9973).cast("double").alias("y"))


def polygons(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    cx, cy = (k * 397 % 9000 + 500).cast("double"), (k * 811 % 9000 + 500).cast("double")
    at = lambda dx, dy: F.struct((cx + dx).alias("x"), (cy + dy).alias("y"))
    return table(spark, d, "nation").select(k.alias("poly_id"), (55 + 5 * (k % 4)).alias("level"), F.array(at(-800, -800), at(800, -800), at(0, 900)).alias("ring"))


def relation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("addr"), F.col("l_suppkey").alias("building"), F.col("l_quantity").cast("double").alias("reliability"), F.col("l_linenumber").alias("tie"))


def pred(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("sale_id")
    return sale(spark, d).select(
        "sale_id", "sale_date", "sale_year", "segment", "area", "surface", "price",
        (F.col("price") * (0.8 + (i * 37 % 41).cast("double") / 100.0)).alias("pred_a"),
        (F.col("price") * (0.7 + (i * 53 % 61).cast("double") / 100.0)).alias("pred_b"),
    )
