"""Categories as ordered target statistics: what earlier rows of the same level were worth, free of leaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that the prior counts for.
STRENGTH = 10.0


def sums_before(daily: DataFrame, asked: DataFrame, by: Sequence[str], span_days: int) -> DataFrame:
    """by, day, n, total: sums of the daily counts and totals up to and with each asked (by, day).

    Both run through one window for each key and span of days, and what earlier spans held is carried in: a busy key is many
    tasks, and a key and day is one row however many rows it has."""
    marks = daily.select(*by, "day", F.lit(0).alias("side"), "n", "total")
    asks = asked.select(*by, "day", F.lit(1).alias("side"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("total"))
    events = marks.unionByName(asks).withColumn("span", F.floor(F.col("day") / span_days))
    # both windows' partitions: a key's spans, and a key's rows of one span
    upto = W.partitionBy(*by, "span").orderBy("day", "side").rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(*by).orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    spans = events.groupBy(*by, "span").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    before = spans.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("span").alias("__span"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__{c}_before") for c in ("n", "total")])
    within = events.select(*by, "day", "side", "span", F.sum("n").over(upto).alias("n"), F.sum("total").over(upto).alias("total")).where("side = 1")
    on = F.col("span") == F.col("__span")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    met = within.join(before, on)
    return met.select(*by, "day", (F.col("n") + F.col("__n_before")).alias("n"), (F.col("total") + F.col("__total_before")).alias("total"))


def ordered_target_stats(df: DataFrame, keys: Sequence[str], day: str, target: Column, lag_days: int = 90, strength: float = STRENGTH, span_days: int = 90) -> DataFrame:
    """df with <key>__n and <key>__mean for every key: how many rows of the same level are at least lag_days older, and the mean of
    their target, drawn towards the mean of all rows so old as if that had been seen `strength` times.

    Rows without a target are encoded and teach nothing. A null level has no history: its mean is the prior. Before any row is old enough,
    and where the day is unknown, the mean is null. Rows of one level and day share their statistics, so none sees itself or its peers."""
    known = df.select(*[F.col(f"`{k}`").cast("string").alias(f"k{i}") for i, k in enumerate(keys)], F.unix_date(F.col(day).cast("date")).cast("long").alias("day"), target.cast("double").alias("y"))
    told = known.where(F.col("y").isNotNull() & ~F.isnan("y") & F.col("day").isNotNull())
    sums = [F.count(F.lit(1)).alias("n"), F.sum("y").alias("total")]
    days = known.where("day IS NOT NULL").select((F.col("day") - lag_days).alias("day")).distinct()
    prior = sums_before(told.groupBy("day").agg(*sums).withColumn("one", F.lit(0)), days.withColumn("one", F.lit(0)), ["one"], span_days)
    prior = prior.select((F.col("day") + lag_days).alias("__day"), F.try_divide("total", "n").alias("__prior"))
    out = df.withColumn("__on", F.unix_date(F.col(day).cast("date")).cast("long")).join(prior, F.col("__on") == F.col("__day"), "left").drop("__day")
    for i, k in enumerate(keys):
        mine = told.where(F.col(f"k{i}").isNotNull())
        asked = known.where(F.col(f"k{i}").isNotNull() & F.col("day").isNotNull()).select(F.col(f"k{i}").alias("key"), (F.col("day") - lag_days).alias("day")).distinct()
        got = sums_before(mine.groupBy(F.col(f"k{i}").alias("key"), "day").agg(*sums), asked, ["key"], span_days)
        got = got.select(F.col("key").alias("__key"), (F.col("day") + lag_days).alias("__day"), F.col("n").alias("__n"), F.col("total").alias("__total"))
        out = out.join(got, (F.col(f"`{k}`").cast("string") == F.col("__key")) & (F.col("__on") == F.col("__day")), "left")
        n, total = F.coalesce("__n", F.lit(0)), F.coalesce("__total", F.lit(0.0))
        out = out.withColumns({f"{k}__n": n, f"{k}__mean": (total + strength * F.col("__prior")) / (n + strength)}).drop("__key", "__day", "__n", "__total")
    return out.drop("__on", "__prior")
