"""Valuation of one property against history: validation, comparables, roll-back of dated records, blend."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propval.functions.scalar import SUFFIXES, address_key
from propval.operators import comps, contracts


@dataclass
class Property:
    """One property to value; `validated` says whether it is in the domain."""

    x: float
    y: float
    surface: float
    rooms: int | None
    on: date
    postal_code: str = ""
    commune: str = ""
    street_code: str = ""
    number: int | None = None
    suffix: str = ""
    asking_price: float | None = None


def normal_suffix(value: str | None) -> str:
    low = (value or "").strip().lower()
    return SUFFIXES.get(low, low)


def normal_address(p: Property) -> str:
    return f"{p.commune}_{p.street_code}_{p.number}_{normal_suffix(p.suffix)}"


def validated(p: Property, surface: tuple[float, float] = (9, 300), rooms: tuple[int, int] = (1, 15), years: tuple[int, int] | None = None, box: tuple[float, float, float, float] | None = None) -> Property:
    """p, or ValueError with what is out of the domain."""
    faults = []
    if not surface[0] <= p.surface <= surface[1]:
        faults.append(f"surface must be within {surface}")
    if p.rooms is not None and not rooms[0] <= p.rooms <= rooms[1]:
        faults.append(f"rooms must be within {rooms}")
    if p.postal_code and not re.fullmatch(r"750(0[1-9]|1[0-9]|20)", p.postal_code):
        faults.append("postal code")
    if p.commune and not re.fullmatch(r"751(0[1-9]|1[0-9]|20)", p.commune):
        faults.append("commune")
    if p.street_code and not re.fullmatch(r"[0-9A-Z]{4}", p.street_code):
        faults.append("street code")
    if p.postal_code and p.commune and p.postal_code[-2:] != p.commune[-2:]:
        faults.append("postal code and commune are of different districts")
    if box and not (box[0] <= p.x <= box[1] and box[2] <= p.y <= box[3]):
        faults.append(f"coordinates must be within {box}")
    if p.number is not None and p.number <= 0:
        faults.append("address number must be positive")
    if p.asking_price is not None and p.asking_price <= 0:
        faults.append("asking price must be positive")
    if years and not years[0] <= p.on.year <= years[1]:
        faults.append(f"date must be within {years}")
    if faults:
        raise ValueError("; ".join(faults))
    return p


def subject(spark: SparkSession, p: Property) -> DataFrame:
    return spark.createDataFrame([(-1, p.on, float(p.x), float(p.y), float(p.surface), p.rooms)], "sale_id long, sale_date date, x double, y double, surface double, rooms int")


def comparables(history: DataFrame, p: Property, lag: int = comps.LAG) -> DataFrame:
    """The one row of comparable features of p: the very function of the batch build, on a history pruned by box and dates."""
    radius, days = max(w[0] for w in comps.WINDOWS), max(w[1] for w in comps.WINDOWS)
    near = history.where(F.col("x").between(p.x - radius, p.x + radius) & F.col("y").between(p.y - radius, p.y + radius) & F.col("sale_date").between(F.lit(p.on - timedelta(days=days)), F.lit(p.on - timedelta(days=lag))))
    return comps.all_features(subject(history.sparkSession, p), near, lag)


def latest_at(history: DataFrame, key: str, value: object, ts: str, at: date, tie: Sequence[str]) -> DataFrame:
    """The latest row of one key on or before a date; of several, the first by `tie`."""
    return history.where((F.col(key) == F.lit(value)) & (F.col(ts) <= F.lit(at))).orderBy(F.col(ts).desc(), *tie).limit(1)


def template(history: DataFrame, key: str, value: object, ts: str, at: date, tie: Sequence[str], keep: Sequence[str], dated: Sequence[str] = (), dated_ts: str | None = None) -> DataFrame:
    """`keep` of the latest row of one building on or before a date, with the columns that depend on a record of its own date
    (`dated`, by `dated_ts`) rolled back: null where that record is later than the date, or missing."""
    row = latest_at(history, key, value, ts, at, tie)
    if dated_ts is None:
        return row.select(*keep)
    known = F.col(dated_ts).isNotNull() & (F.col(dated_ts) <= F.lit(at))
    return row.select(*keep, *[F.when(known, F.col(c)).alias(c) for c in dated], F.when(known, F.datediff(F.lit(at), F.col(dated_ts))).alias("record_age_days"))


def located(addresses: DataFrame, p: Property, limit: float = 250.0) -> tuple[Property, dict]:
    """p at its address's coordinates, and how it was found: the exact key's best row; p's own coordinates where there is no
    such address or the address has none. An address further than `limit` metres from p's coordinates is an error.

    addresses: canonical_address_key, x, y, and whatever else orders the rows of a key."""
    key = addresses.select(address_key(F.lit(p.commune), F.lit(p.street_code), F.lit(p.number), F.lit(normal_suffix(p.suffix))).alias("k")).limit(1)
    own = addresses.join(F.broadcast(key), addresses["canonical_address_key"] == key["k"]).drop("k")
    row = own.orderBy(*[F.col(c).desc_nulls_last() for c in sorted(own.columns)]).limit(1).collect()
    if not row or row[0]["x"] is None or row[0]["y"] is None:
        return p, {"method": "coordinates" if not row else "exact_key_without_coordinates", "distance_m": None}
    distance = contracts.close_to(row[0]["x"], row[0]["y"], p.x, p.y, limit)
    return replace(p, x=row[0]["x"], y=row[0]["y"]), {"method": "exact_key", "distance_m": distance, **{k: v for k, v in row[0].asDict().items() if k not in ("x", "y")}}


def blended(base: float, local_median: float | None, surface: float, weight: float) -> float:
    """weight * base + (1 - weight) * local median * surface; the base without comparables."""
    return base if local_median is None else weight * base + (1 - weight) * local_median * surface
