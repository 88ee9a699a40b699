"""Cohort cleaning: transaction lines to one row per single-item sale, under explicit quality rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def single_item_groups(lines: DataFrame, group: str, counts: dict[str, tuple[Column, int]]) -> DataFrame:
    """Groups in which each named condition holds for exactly so many lines. Null groups are none."""
    names = {f"__n{i}": v for i, v in enumerate(counts.values())}
    agg = lines.where(F.col(group).isNotNull()).groupBy(group).agg(*[F.count_if(c).alias(n) for n, (c, _) in names.items()])
    for n, (_, exact) in names.items():
        agg = agg.where(F.col(n) == exact)
    return agg.select(group)


def eligible_lines(lines: DataFrame, group: str, counts: dict[str, tuple[Column, int]], keep: Column) -> DataFrame:
    """Lines of eligible groups for which `keep` holds."""
    return lines.where(keep).join(single_item_groups(lines, group, counts), group, "left_semi")


def complete(df: DataFrame, required: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(required))


def in_ranges(df: DataFrame, ranges: dict[str, tuple[float, float]], patterns: dict[str, str] | None = None) -> DataFrame:
    """Rows within all ranges (both ends included) and fully matching all patterns."""
    for c, (low, high) in ranges.items():
        df = df.where(F.col(c).between(low, high))
    for c, rx in (patterns or {}).items():
        df = df.where(F.col(c).rlike(f"^(?:{rx})$"))
    return df


def with_calendar(df: DataFrame, date: str, base_year: int) -> DataFrame:
    d = F.col(date)
    return df.withColumns({"month": F.month(d), "day_of_year": F.dayofyear(d), "year": F.year(d), f"months_since_{base_year}": (F.year(d) - base_year) * 12 + F.month(d) - 1})


def clean_sales(lines: DataFrame) -> DataFrame:
    """Property lines (typed strings and numbers) to one row per sale of a single apartment."""
    sold = lines.where("nature_mutation = 'Vente'").withColumn("date_mutation", F.col("date_mutation").try_cast("date"))
    kind = F.col("code_type_local")
    one = eligible_lines(sold, "id_mutation", {"flat": (kind == "2", 1), "house": (kind == "1", 0), "shop": (kind == "4", 0)}, kind == "2")
    whole = complete(one, ["date_mutation", "valeur_fonciere", "surface_reelle_bati", "code_postal", "latitude", "longitude"])
    priced = whole.withColumn("price_per_m2", F.try_divide("valeur_fonciere", "surface_reelle_bati"))
    ranges = {"surface_reelle_bati": (9, 300), "valeur_fonciere": (50_000, 10_000_000), "price_per_m2": (2_000, 30_000), "latitude": (48.80, 48.92), "longitude": (2.20, 2.48)}
    return with_calendar(in_ranges(priced, ranges, {"code_postal": "750(0[1-9]|1[0-9]|20)"}), "date_mutation", 2021)


def year_split(df: DataFrame, year: str, train_end: int, validation: int, test: int, minimum: int = 1000) -> dict[str, DataFrame]:
    """development (<= train_end), validation, final_train (<= validation) and test; each of the first, second and last must have `minimum` rows."""
    y = F.col(year)
    out = {"development": df.where(y <= train_end), "validation": df.where(y == validation), "final_train": df.where(y <= validation), "test": df.where(y == test)}
    n = df.agg(F.count_if(y <= train_end).alias("development"), F.count_if(y == validation).alias("validation"), F.count_if(y == test).alias("test")).first()
    for name in ("development", "validation", "test"):
        if n[name] < minimum:
            raise ValueError(f"{name} has {n[name]} rows; at least {minimum} are needed")
    return out
