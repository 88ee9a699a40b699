"""Entity resolution: ranked one-best relations, exact keys with fallback, confidence tiers, audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def one_best(relation: DataFrame, key: str | Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by an explicit, total order. Rows with a null key are none."""
    keys = [key] if isinstance(key, str) else list(key)
    known = relation
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    return known.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def candidate_counts(relation: DataFrame, key: str, name: str) -> DataFrame:
    """Rows of the relation for each key; null keys are none."""
    return relation.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name))


def lookup(df: DataFrame, table: DataFrame, key: str, column: str, default: object) -> DataFrame:
    """df with `column` of table's row for its key, else the default. The planner broadcasts table if it is small."""
    return df.join(table.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def address_match(sales: DataFrame, addresses: DataFrame, key: str) -> DataFrame:
    """Exact match on the canonical key: id, method, distance and confidence."""
    out = sales.join(addresses, key, "left")
    d = F.hypot(F.col("x") - F.col("ban_x"), F.col("y") - F.col("ban_y"))
    there = F.col("ban_address_id").isNotNull()
    return out.withColumns(
        {
            "ban_match_method": F.when(there, "exact_key").otherwise("unmatched"),
            "ban_match_distance_m": d,
            "ban_match_confidence": F.when(~there, 0.0).when(d <= 100, 1.0).otherwise(0.85),
        }
    )


def resolve_buildings(df: DataFrame, by_address: str, by_parcel: str, reliability: str, address_candidates: str, parcel_candidates: str) -> DataFrame:
    """building_id (address first, parcel as fallback), method and confidence tier."""
    a, p = F.col(by_address).isNotNull(), F.col(by_parcel).isNotNull()
    return df.withColumns(
        {
            "building_id": F.coalesce(by_address, by_parcel),
            "match_method": F.when(a, "address_relation").when(p, "principal_parcel").otherwise("unmatched"),
            "match_confidence": F.when(a & (F.col(reliability) >= 15) & (F.col(address_candidates) == 1), 1.0)
            .when(a, 0.8)
            .when(p & (F.col(parcel_candidates) == 1), 0.7)
            .when(p, 0.5)
            .otherwise(0.0),
        }
    )


def audit(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The Silver audit: one row per sale with what it was matched to and how."""
    return df.select(key, *columns)


def match_rates(df: DataFrame, method: str = "match_method", confidence: str = "match_confidence") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg((F.col(method) != "unmatched").cast("double")).alias("match_rate"),
        F.avg((F.col(confidence) >= 0.8).cast("double")).alias("high_confidence_rate"),
    )


def stitched(base: DataFrame, others: Sequence[DataFrame], key: str, order: Sequence[Sequence[Column]]) -> DataFrame:
    """base with the columns of each other table, reduced to one row per key first."""
    for other, by in zip(others, order, strict=True):
        base = base.join(one_best(other, key, by), key, "left")
    return base


def building_features(df: DataFrame, numeric: Sequence[str], year: str, built: str) -> DataFrame:
    """Lenient numbers, age at sale within 0..1000, missing flags, and floor and lift never made up."""
    out = df.withColumns({c: F.col(c).try_cast("double") for c in numeric})
    age = F.col(year) - F.col(built)
    return out.withColumns(
        {
            "building_age_at_sale": F.when(age.between(0, 1000), age),
            "building_year_missing": F.col(built).isNull().cast("byte"),
            "apartment_floor": F.lit(None).cast("double"),
            "apartment_floor_available": F.lit(0).cast("byte"),
            "elevator_available": F.lit(None).cast("double"),
            "elevator_source_available": F.lit(0).cast("byte"),
        }
    )
