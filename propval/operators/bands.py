"""Order statistics of values among the rows of a group whose place is in a band, for many bands at once and without pairs.

The rows of a group are cut by value into blocks, and every block meets the group's asks, dealt into a few parts: a block and a part are one
task's work. There the block's rows stand in the order of their places, so a band is a slice; a first pass counts the slices, which tells
the blocks that hold the ranks that an ask seeks. In a second pass a wavelet matrix of the block (one level a bit of the values' ranks) finds a
rank of a slice, or how many of it are below a bound, in as many steps as it has levels, for all asks together."""

from __future__ import annotations

from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from propval.session import written

if TYPE_CHECKING:
    import pyarrow as pa

#: Rows of a block and asks of a part, until a group has MOST of either; beyond, these grow and not their number.
BLOCK_ROWS, PART_ASKS, MOST = 1 << 20, 1 << 16, 64


class Wavelet:
    """Of an array: the k-th smallest of a slice, and how many of a slice are below a bound."""

    def __init__(self, values: np.ndarray) -> None:
        self.known, rest = np.unique(values, return_inverse=True)
        self.levels = []
        for shift in reversed(range(max(int(len(self.known) - 1).bit_length(), 1))):
            high = (rest >> shift) & 1 == 1
            zeros = np.concatenate([[0], np.cumsum(~high)])
            self.levels.append((shift, zeros))
            rest = np.concatenate([rest[~high], rest[high]])

    def kth(self, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
        rank = np.zeros(len(k), dtype=np.int64)
        for shift, zeros in self.levels:
            a, b = zeros[left], zeros[right]
            up = k >= b - a
            k = np.where(up, k - (b - a), k)
            left, right = np.where(up, left - a + zeros[-1], a), np.where(up, right - b + zeros[-1], b)
            rank |= up.astype(np.int64) << shift
        return self.known[rank]

    def below(self, left: np.ndarray, right: np.ndarray, bound: np.ndarray) -> np.ndarray:
        upto, every, found = np.searchsorted(self.known, bound, "left"), right - left, np.zeros(len(bound), dtype=np.int64)
        for shift, zeros in self.levels:
            a, b = zeros[left], zeros[right]
            up = (upto >> shift) & 1 == 1
            found += np.where(up, b - a, 0)
            left, right = np.where(up, left - a + zeros[-1], a), np.where(up, right - b + zeros[-1], b)
        return np.where(upto >= len(self.known), every, found)


def numbered(rows: DataFrame) -> DataFrame:
    """rows (g, v, others) with rank, their number within g by v, from 0. One global sort; ties are split by a number, so that one value may be
    as frequent as it likes."""
    ordered = rows.withColumn("tie", F.monotonically_increasing_id()).orderBy("g", "v", "tie").drop("tie")
    ordered = written(ordered.withColumns({"at": F.monotonically_increasing_id(), "part": F.spark_partition_id()}), "ranks")
    runs = ordered.groupBy("g", "part").agg(F.count(F.lit(1)).alias("n"))
    runs = runs.select("g", "part", F.coalesce(F.sum("n").over(W.partitionBy("g").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    upto = F.row_number().over(W.partitionBy("g", "part").orderBy("at"))  # a sorted partition, not a group
    return ordered.withColumn("upto", upto).join(runs, ["g", "part"]).withColumn("rank", F.col("upto") + F.col("before") - 1).drop("at", "part", "upto", "before")


def slices(asks: pa.Table, rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The values in the order of their places, and of each ask where its band begins and ends, and its rows."""
    p, v = rows["p"].to_numpy(), rows["v"].to_numpy()
    order = np.argsort(p, kind="stable")
    left, right = np.searchsorted(p[order], asks["low"].to_numpy(), "left"), np.searchsorted(p[order], asks["high"].to_numpy(), "right")
    return v[order], left, right, np.maximum(right - left, 0)


def count_block(asks: pa.Table, rows: pa.Table) -> pa.Table:
    """key, block and its count of the asks that have a row there."""
    import pyarrow as pa

    counts = slices(asks, rows)[3] if len(asks) and len(rows) else np.zeros(len(asks), dtype=np.int64)
    some = np.flatnonzero(counts)
    return pa.table({"key": asks["key"].take(some), "block": asks["block"].take(some), "own": pa.array(counts[some])})


def solve_block(asks: pa.Table, rows: pa.Table) -> pa.Table:
    """key, n and for each thing sought what this block knows of it: i, low, high, count."""
    import pyarrow as pa

    if not len(asks) or not len(rows):
        asks = asks.slice(0, 0)
    values, left, right, own = slices(asks, rows)
    sought = {c: asks[c].combine_chunks() for c in ("i", "share", "bound")}
    lengths = asks["i"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = {c: (x.flatten().to_numpy(zero_copy_only=False)) for c, x in sought.items()}
    who = np.repeat(np.arange(len(asks)), lengths)
    n, before = asks["n"].to_numpy()[who], asks["before"].to_numpy()[who]
    share, bound = flat["share"].astype(float), flat["bound"].astype(float)
    ends, wavelet = {}, Wavelet(values)
    place = share * (n - 1)
    for name, rank in (("low", np.floor(place)), ("high", np.ceil(place))):
        k = np.where(np.isnan(rank), -1, rank).astype(np.int64) - before
        mine = np.flatnonzero((k >= 0) & (k < own[who]) & ~np.isnan(rank))
        got = np.full(len(who), np.nan)
        got[mine] = wavelet.kth(left[who[mine]], right[who[mine]], k[mine])
        ends[name] = np.ma.array(got, mask=np.isin(np.arange(len(who)), mine, invert=True))
    asked = np.flatnonzero(np.isnan(share) & ~np.isnan(bound))
    count = np.zeros(len(who), dtype=np.int64)
    count[asked] = wavelet.below(left[who[asked]], right[who[asked]], bound[asked])
    none = np.ones(len(who), dtype=bool)
    none[asked] = False
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
    listed = lambda x, mask=None: pa.ListArray.from_arrays(offsets, pa.array(x, mask=mask))
    return pa.table({"key": asks["key"], "n": asks["n"], "i": listed(flat["i"].astype(np.int32)), "low": listed(ends["low"].data, np.ma.getmaskarray(ends["low"])), "high": listed(ends["high"].data, np.ma.getmaskarray(ends["high"])), "count": listed(count, none)})


def band_statistics(rows: DataFrame, asks: DataFrame, seeks: str = "seeks") -> DataFrame:
    """What each ask wants to know of the values v of the rows (g, p, v) of its group with low <= p <= high.

    asks: key, g, low, high, `seeks`: an array of struct(i, share, bound): with a share the quantile of it, else how many values are below the
    bound. Returns key, n (the rows of the band), and `found`: an array of struct(i, low, high, count) in the order of i: the two neighbours of
    a quantile, or the count. An ask without rows has no row. What a task holds is a block of a group and a part of its asks."""
    bound = lambda s: F.when(F.isnan(s["bound"]), float("inf")).otherwise(s["bound"])
    asks = asks.where("low <= high").select("key", "g", "low", "high", F.transform(seeks, lambda s: s["i"].cast("int")).alias("i"), F.transform(seeks, lambda s: s["share"].cast("double")).alias("share"), F.transform(seeks, bound).alias("bound"))
    asks, rows = written(asks, "band-asks"), written(rows.select("g", "p", "v"), "band-rows")
    size = lambda n, least: F.greatest(F.lit(least), F.ceil(F.col(n) / MOST))
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("rows")).join(asks.groupBy("g").agg(F.count(F.lit(1)).alias("asks")), "g")
    sizes = written(sizes.select("g", size("rows", BLOCK_ROWS).alias("of_block"), F.ceil(F.col("rows") / size("rows", BLOCK_ROWS)).alias("blocks"), F.ceil(F.col("asks") / size("asks", PART_ASKS)).alias("parts")), "band-sizes")
    if (sizes.agg(F.max("blocks")).first()[0] or 0) > 1:
        rows = numbered(rows).join(sizes, "g").withColumn("block", F.floor(F.col("rank") / F.col("of_block")))
    else:
        rows = rows.join(sizes, "g").withColumn("block", F.lit(0).cast("long"))
    shuffles, by = int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions")), ("g", "block", "part")
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(*by, "p", "v").repartition(shuffles, *by)
    dealt = asks.join(sizes, "g").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts"))).drop("of_block", "parts")
    met = lambda df: df.repartition(shuffles, *by).groupBy(*by).cogroup(rows.groupBy(*by))
    kind = asks.schema["key"].dataType.simpleString()
    each = dealt.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    own = met(each.select(*by, "key", "low", "high")).applyInArrow(count_block, f"key {kind}, block bigint, own bigint")
    run = W.partitionBy("key")
    own = own.withColumns({"n": F.sum("own").over(run), "before": F.coalesce(F.sum("own").over(run.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    told = met(dealt.join(own, "key")).applyInArrow(solve_block, f"key {kind}, n bigint, i array<int>, low array<double>, high array<double>, count array<bigint>")
    whole = told.groupBy("key", "n").agg(F.first("i").alias("i"), F.collect_list(F.struct("low", "high", "count")).alias("parts"))
    over = lambda f, c: F.transform("i", lambda _, j: f(F.transform("parts", lambda x: F.get(x[c], j))))
    total = lambda a: F.aggregate(a, F.lit(None).cast("long"), lambda s, x: F.coalesce(s + x, s, x))
    whole = whole.select("key", "n", "i", over(F.array_max, "low").alias("low"), over(F.array_max, "high").alias("high"), over(total, "count").alias("count"))
    return whole.select("key", "n", F.sort_array(F.arrays_zip("i", "low", "high", "count")).alias("found"))
