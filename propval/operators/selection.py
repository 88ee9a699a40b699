"""Exact quantiles by distributed selection: no task holds a column or a group of it."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets to a power of e (values below SMALL share linear ones), and buckets that are first counted together.
FINE, SMALL, TOGETHER = 1 << 16, 2.0**-30, 1 << 10


def bucket(v: Column) -> Column:
    """A whole number that never falls as v grows; logarithmic on both sides of zero."""
    return (F.signum(v) * F.floor(F.ln(F.lit(1.0) + F.abs(v) / F.lit(SMALL)) * FINE)).cast("long")


def hit(counted: DataFrame, within: Sequence[str], order: str) -> DataFrame:
    """Of counted rows (n each, and `asks`, the ranks sought in their group) those that hold a rank sought, with `asks`
    reduced to these, counted from the row's own first."""
    before = F.coalesce(F.sum("n").over(W.partitionBy(*within).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = counted.withColumn("__before", before)
    own = F.filter("asks", lambda a: (a["rank"] >= F.col("__before")) & (a["rank"] < F.col("__before") + F.col("n")))
    own = F.transform(own, lambda a: F.struct(a["i"].alias("i"), a["share"].alias("share"), (a["rank"] - F.col("__before")).alias("rank")))
    return placed.withColumn("asks", own).where(F.size("asks") > 0).drop("__before", "n")


def selected(df: DataFrame, by: Sequence[str], column: str, probs: Sequence[float]) -> DataFrame:
    """by, n and q: for each group with a value the exact quantiles, linearly interpolated (an array in the order of probs).

    Nulls and NaN are left out; a null key is a key. Values are counted by narrow logarithmic buckets, these are counted together,
    and in the buckets that hold a sought rank values are counted one by one: two passes over the values, and windows over
    counts alone."""
    key = F.struct(*by) if by else F.lit(0)
    v = F.col(f"`{column}`").cast("double")
    values = df.select(key.alias("__g"), v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")).withColumn("b", bucket(F.col("v")))
    fine = values.groupBy("__g", "b").agg(F.count(F.lit(1)).alias("n")).withColumn("c", F.floor(F.col("b") / TOGETHER))
    coarse = fine.groupBy("__g", "c").agg(F.sum("n").alias("n")).withColumn("total", F.sum("n").over(W.partitionBy("__g")))
    asks = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("total") - 1)
        asks += [F.struct(F.lit(i).alias("i"), (at - F.floor(at)).alias("share"), rank.alias("rank")) for rank in (F.floor(at), F.ceil(at))]
    coarse = hit(coarse.withColumn("asks", F.array(*asks)), ["__g"], "c")
    narrow = hit(fine.join(coarse, ["__g", "c"]), ["__g", "c"], "b").drop("c")
    single = values.join(narrow, ["__g", "b"]).groupBy("__g", "b", "v").agg(F.count(F.lit(1)).alias("n"), F.first("asks").alias("asks"), F.first("total").alias("total"))
    found = hit(single, ["__g", "b"], "v")
    ends = F.flatten(F.collect_list(F.transform("asks", lambda a: F.struct(a["i"].alias("i"), F.col("v").alias("v"), a["share"].alias("share")))))
    out = found.groupBy("__g").agg(F.first("total").alias("n"), F.sort_array(ends).alias("ends"))

    def of(i: int) -> Column:
        low, high, share = F.col("ends")[2 * i]["v"], F.col("ends")[2 * i + 1]["v"], F.col("ends")[2 * i]["share"]
        return F.when(low == high, low).otherwise((F.lit(1.0) - share) * low + share * high)

    return out.select(*[F.col(f"__g.{c}").alias(c) for c in by], "n", F.array(*[of(i) for i in range(len(probs))]).alias("q"))


def selected_columns(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """column, n, q: quantiles of several columns in the same passes; a column without values has no row."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])).alias("x")).select("x.*")
    return selected(long, ["column"], "value", probs)


#: Parts that `selected_few` cuts an interval into.
PARTS = 1024


def selected_few(df: DataFrame, by: str | None, column: str, probs: Sequence[float]) -> dict[object, list[float]]:
    """The same quantiles for a few groups (the nodes of a tree, say), in fewer and smaller jobs: the driver narrows each rank's
    interval, by at least PARTS a pass, and holds groups x probs x PARTS counts at most."""
    key = F.col(by) if by else F.lit(0)
    v = F.col(f"`{column}`").cast("double")
    values = df.select(key.alias("g"), v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    extent = [F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")]
    counted: dict[object, list] = {}
    for r in values.groupBy("g", F.floor(bucket(F.col("v")) / (FINE // 32)).alias("c")).agg(*extent).collect():
        counted.setdefault(r["g"], []).append(r)
    at = {g: [p * (sum(r["n"] for r in rows) - 1) for p in probs] for g, rows in counted.items()}
    solved: dict[tuple, float] = {}

    def narrow(cells: list, g: object, ranks: dict[int, int]) -> list:
        """Solves or narrows ranks (rank in the group: rank within the cells); returns the intervals left."""
        left, before = [], 0
        for r in sorted(cells, key=lambda r: r["low"]):
            inside = {k: i - before for k, i in ranks.items() if before <= i < before + r["n"]}
            before += r["n"]
            for k, i in list(inside.items()):
                if r["low"] == r["high"] or i == 0 or i == r["n"] - 1:
                    solved[g, k] = r["low"] if i == 0 else r["high"]
                    del inside[k]
            if inside:
                left.append((g, r["low"], r["high"], inside))
        return left

    open_ = [x for g, rows in counted.items() for x in narrow(rows, g, {int(k): int(k) for a in at[g] for k in (math.floor(a), math.ceil(a))})]
    kind = values.schema["g"].dataType
    while open_:
        spans = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(g).cast(kind).alias("g"), F.lit(low).alias("low"), F.lit(high).alias("high")) for i, (g, low, high, _) in enumerate(open_)])
        # few values lie in an open interval: the others are dropped before each is looked up
        inside = functools.reduce(Column.__or__, [F.col("g").eqNullSafe(F.lit(g).cast(kind)) & F.col("v").between(low, high) for g, low, high, _ in open_]) if len(open_) <= 64 else F.lit(True)
        own = F.get(F.filter(spans, lambda x: x["g"].eqNullSafe(F.col("g")) & F.col("v").between(x["low"], x["high"])), F.lit(0))
        span = F.col("m.high") - F.col("m.low")
        cut = F.least(F.floor((F.col("v") - F.col("m.low")) / span * PARTS), F.lit(PARTS - 1))
        cells: dict[int, list] = {}
        for r in values.where(inside).withColumn("m", own).where("m IS NOT NULL").groupBy("m.i", cut.alias("c")).agg(*extent).collect():
            cells.setdefault(r["i"], []).append(r)
        open_ = [x for i, (g, _, _, ranks) in enumerate(open_) for x in narrow(cells[i], g, ranks)]

    def quantile(g: object, a: float) -> float:
        low, high, share = solved[g, math.floor(a)], solved[g, math.ceil(a)], a - math.floor(a)
        return low if low == high else (1.0 - share) * low + share * high

    return {g: [quantile(g, a) for a in ranks] for g, ranks in at.items()}
