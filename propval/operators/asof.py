"""Backward as-of join: the latest record of the same key at or before each probe's time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def latest(probes: DataFrame, records: DataFrame, key: str, probe_ts: str, record_ts: str, tie: str, values: list[str], span_days: int = 30) -> DataFrame:
    """probes with record_ts, tie and values of the latest record with record_ts <= probe_ts; nulls if there is none.

    Both sides run through one window for each key and span of days, ordered by time, records before probes at equal times and by
    `tie` (the greatest wins); the last record of the spans before is carried in. So a busy key is many tasks, and there are no
    pairs. Null keys never match; they are kept out of the windows."""
    carried = [record_ts, tie, *[v for v in values if v not in (record_ts, tie)]]
    record = F.struct(*[F.col(c).alias(c) for c in carried])
    left = probes.where(F.col(key).isNotNull() & F.col(probe_ts).isNotNull())
    both = left.select(F.col(key).alias("__k"), F.col(probe_ts).alias("__t"), F.lit(1).alias("__side"), F.struct(*probes.columns).alias("__probe"), F.lit(None).cast(records.select(record.alias("r")).schema["r"].dataType).alias("__record"), F.lit(None).cast(records.schema[tie].dataType).alias("__tie")).unionByName(
        records.where(F.col(key).isNotNull() & F.col(record_ts).isNotNull()).select(
            F.col(key).alias("__k"), F.col(record_ts).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(F.struct(*probes.columns).alias("p")).schema["p"].dataType).alias("__probe"), record.alias("__record"), F.col(tie).alias("__tie")
        )
    )
    day = F.col("__t") if isinstance(both.schema["__t"].dataType, NumericType) else F.unix_date(F.col("__t").cast("date"))  # numbers count as days
    both = both.withColumn("__span", F.floor(day / span_days))
    order = W.partitionBy("__k", "__span").orderBy("__t", "__side", F.col("__tie").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    ends = both.groupBy("__k", "__span").agg(F.max_by("__record", F.when(F.col("__side") == 0, F.struct("__t", "__tie"))).alias("__end"))
    earlier = W.partitionBy("__k").orderBy("__span").rowsBetween(W.unboundedPreceding, -1)  # a row a span
    ends = ends.select("__k", "__span", F.last("__end", ignorenulls=True).over(earlier).alias("__before"))
    found = both.withColumn("__in", F.last("__record", ignorenulls=True).over(order)).where("__side = 1").join(ends, ["__k", "__span"])
    found = found.withColumn("__last", F.coalesce("__in", "__before")).select("__probe.*", "__last.*")
    rest = probes.where(F.col(key).isNull() | F.col(probe_ts).isNull())
    return found.unionByName(rest, allowMissingColumns=True)


def leakage(joined: DataFrame, probe_ts: str, record_ts: str) -> int:
    """Rows whose record is later than the probe; must be 0."""
    return joined.where(F.col(record_ts) > F.col(probe_ts)).count()


def diagnostic_features(joined: DataFrame, sale_ts: str, record_ts: str, record_surface: str, sale_surface: str) -> DataFrame:
    """Availability flag, age in whole days, surface difference ratio and match confidence of as-of records."""
    from propval.functions.scalar import floored_days, relative_difference

    ratio = relative_difference(F.col(record_surface).cast("double"), F.col(sale_surface).cast("double"))
    there = F.col(record_ts).isNotNull()
    return joined.withColumns(
        {
            "dpe_available_at_sale": there.cast("byte"),
            "dpe_age_days": floored_days(F.col(sale_ts), F.col(record_ts)),
            "dpe_surface_difference_ratio": ratio,
            "dpe_match_confidence": F.when(~there, 0.0).when(ratio <= 0.15, 1.0).otherwise(0.6),
        }
    )
