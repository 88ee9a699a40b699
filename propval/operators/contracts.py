"""Quality contracts, checked on aggregates before anything is published."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class ContractError(RuntimeError):
    """A published table would break a contract."""


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """key, n of the keys that occur more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unique(df: DataFrame, key: str, examples: int = 5) -> None:
    twice = [r[0] for r in duplicates(df, key).orderBy(key).limit(examples).collect()]
    if twice:
        raise ContractError(f"{key} is not unique, as in {twice}")


def row_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, change: rows that `after` has more (or, below 0, fewer) of a key than `before`."""
    return before.select(key, F.lit(-1).alias("change")).unionByName(after.select(key, F.lit(1).alias("change"))).groupBy(key).agg(F.sum("change").alias("change")).where("change <> 0")


def same_rows(before: DataFrame, after: DataFrame, key: str) -> None:
    """after has before's ids, each once."""
    odd = [r[0] for r in row_changes(before, after, key).limit(5).collect()]
    if odd:
        raise ContractError(f"rows were lost or multiplied: {odd}")


def many_to_one(right: DataFrame, key: str) -> DataFrame:
    """right, if its (non-null) keys are unique; to check a lookup side before a join."""
    unique(right.where(F.col(key).isNotNull()), key)
    return right


def one_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """The join on key, if neither side has a (non-null) key twice."""
    return many_to_one(left, key).join(many_to_one(right, key), key, how)


def out_of_order(df: DataFrame, order: str, date: str, run: int = 100_000) -> DataFrame:
    """The rows that come, along `order`, after a row of a later date. Two levels, so that no task holds the table: runs of the order, each
    on its own, and the latest date of all runs before it."""
    spans = df.withColumn("__run", F.floor(F.col(order) / run))
    inner = F.max(date).over(W.partitionBy("__run").orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    ends = spans.groupBy("__run").agg(F.max(date).alias("__hi"))  # a row for every run
    earlier = ends.select("__run", F.max("__hi").over(W.orderBy("__run").rowsBetween(W.unboundedPreceding, -1)).alias("__earlier"))
    return spans.withColumn("__before", inner).join(earlier, "__run").where((F.col(date) < F.col("__before")) | (F.col(date) < F.col("__earlier"))).drop("__run", "__before", "__earlier")


def chronological(df: DataFrame, order: str, date: str) -> None:
    """Dates never fall along `order`."""
    if not out_of_order(df, order, date).isEmpty():
        raise ContractError(f"{date} is out of order")


def no_future(df: DataFrame, record_ts: str, subject_ts: str) -> None:
    n = df.where(F.col(record_ts) > F.col(subject_ts)).count()
    if n:
        raise ContractError(f"{n} rows know a record from after their own date")


def at_least(df: DataFrame, n: int, what: str) -> None:
    have = df.limit(n).count()
    if have < n:
        raise ContractError(f"{what}: {have} rows, at least {n} are needed")


def no_overlap(df: DataFrame, key: str, source: str) -> None:
    """No id occurs in two sources."""
    odd = [r[0] for r in df.groupBy(key).agg(F.count_distinct(source).alias("n")).where("n > 1").orderBy(key).limit(5).collect()]
    if odd:
        raise ContractError(f"{key} is in several files, as in {odd}")


def columns(df: DataFrame, expected: Sequence[str]) -> None:
    missing = [c for c in expected if c not in df.columns]
    if missing:
        raise ContractError(f"columns are missing: {missing}")


def names(tables: dict[str, DataFrame], expected: Sequence[str]) -> None:
    missing = [t for t in expected if t not in tables]
    if missing:
        raise ContractError(f"tables are missing: {missing}")


def digest(df: DataFrame) -> str:
    """A digest of a table's content, whatever its order and files."""
    row = df.agg(F.count(F.lit(1)), *[F.bit_xor(F.xxhash64(F.lit(k), *[F.col(f"`{c}`") for c in df.columns])) for k in (0, 1)]).first()
    return f"{row[0]:x}-{(row[1] or 0) & (2**64 - 1):016x}{(row[2] or 0) & (2**64 - 1):016x}"


def close_to(x: float, y: float, tx: float, ty: float, limit: float = 250.0) -> float:
    """Distance of an address from its coordinates; an error beyond the limit."""
    d = ((x - tx) ** 2 + (y - ty) ** 2) ** 0.5
    if d > limit:
        raise ContractError(f"address and coordinates are {d:.0f} m apart")
    return d


def report(df: DataFrame, flags: Sequence[str] = ()) -> dict:
    """Rows, columns, share of each flag and null rate of each column, from one pass."""
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.avg(F.col(f).cast("double")).alias(f"f_{f}") for f in flags], *[F.round(F.avg(F.col(f"`{c}`").isNull().cast("double")), 6).alias(f"m_{i}") for i, c in enumerate(df.columns)]).first()
    return {"rows": row["rows"], "columns": len(df.columns), "rates": {f: row[f"f_{f}"] for f in flags}, "missing": {c: row[f"m_{i}"] for i, c in enumerate(df.columns)}}
