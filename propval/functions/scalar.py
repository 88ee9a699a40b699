"""Scalar column functions: keys, text, dates, ratios. All are plain expressions; null in gives null out unless said otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SUFFIXES = {"bis": "b", "ter": "t", "quater": "q"}

# Names of the feature families and their prefixes; the first that fits counts.
FAMILIES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Historical comparables", ("local_", "weighted_", "similar_", "effective_", "nearest_", "median_comparable")),
    ("DPE / energy", ("dpe_", "classe_", "conso_", "emission_", "type_installation", "type_energie", "annee_construction_dpe", "nombre_niveau", "surface_habitable")),
    ("Building / linkage", ("building_", "bdnb_", "ban_", "usage_", "mat_")),
    ("Neighborhood context", ("distance_metro", "distance_rer", "distance_train", "distance_tram", "rail_", "distance_school", "school_", "distance_green", "green_", "distance_shop", "shop_", "noise_")),
)
IDENTITY = ("ban_address_id", "bdnb_building_id", "bdnb_match_method", "cell_r8", "cell_r9")

# Names of features in reports; others are their own words.
LABELS = {
    "bdnb_building_id": "BDNB building identity",
    "ban_address_id": "BAN address identity",
    "surface_reelle_bati": "Apartment surface",
    "local_365d_500m_median_ppm2": "Local median EUR/m2 (365d, 500m)",
    "local_730d_500m_median_ppm2": "Local median EUR/m2 (730d, 500m)",
    "weighted_comp_ppm2": "Weighted comparable EUR/m2",
    "similar_weighted_comp_ppm2": "Similar comparable EUR/m2",
    "longitude": "Longitude",
    "latitude": "Latitude",
    "building_age_at_sale": "Building age at sale",
    "building_year": "Construction year",
    "classe_bilan_dpe": "DPE energy class",
    "distance_metro_m": "Distance to Metro",
    "noise_transport_lden_max_db": "Maximum transport noise",
    "code_postal": "Arrondissement",
    "months_since_2021": "Market time trend",
}


def zero_filled(c: Column, width: int) -> Column:
    """Left-padded with zeros; longer values stay whole."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def integer_text(c: Column) -> Column:
    """Integer form of a numeric code: no decimals, no leading zeros; null where it is no integer."""
    d = c.try_cast("double")
    return F.when(d == F.floor(d), d.try_cast("long").cast("string"))


def suffix_code(c: Column) -> Column:
    """Repetition suffix: bis, ter and quater become b, t and q; others are trimmed and lower-cased; null is empty."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    out = low
    for word, code in SUFFIXES.items():
        out = F.when(low == word, code).otherwise(out)
    return out


def address_key(commune: Column, road: Column, number: Column, suffix: Column) -> Column:
    """commune_RRRR_NNNNN[_suffix]; null if commune, road or number is."""
    tail = F.lower(F.trim(F.coalesce(suffix, F.lit(""))))
    base = F.concat(F.trim(commune), F.lit("_"), zero_filled(F.right(F.trim(road), F.lit(4)), 4), F.lit("_"), zero_filled(integer_text(number), 5))
    return F.concat(base, F.when(tail != "", F.concat(F.lit("_"), tail)).otherwise(""))


def street_id(commune: Column, road: Column) -> Column:
    return F.concat(F.coalesce(commune, F.lit("unknown")), F.lit("_"), F.coalesce(road, F.lit("unknown")))


def address_id(commune: Column, road: Column, number: Column, suffix: Column) -> Column:
    """street_number_suffix, with -1 for a missing number; the last underscore stays where there is no suffix."""
    return F.concat(street_id(commune, road), F.lit("_"), F.coalesce(integer_text(number), F.lit("-1")), F.lit("_"), F.lower(F.trim(F.coalesce(suffix, F.lit("")))))


def parcel_id(parcel: Column) -> Column:
    return F.coalesce(parcel, F.lit("unknown"))


def quoted_tokens(c: Column) -> Column:
    """Number of quoted items in a list kept as text, at least 1; null counts 1."""
    return F.greatest(F.lit(1), F.coalesce(F.regexp_count(c, F.lit('"([^"]+)"')), F.lit(1)))


def first_integer(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d+)", 1).try_cast("int")


def feature_family(name: Column) -> Column:
    out = F.when(name.isin(*IDENTITY), "Identity / micro-location")
    for family, prefixes in FAMILIES:
        for p in prefixes:
            out = out.when(name.startswith(p), family)
    return out.otherwise("Core DVF / spatial")


def label_of(name: Column) -> Column:
    """The feature's name in LABELS, else underscores to spaces, first letter capital."""
    text = F.translate(name, "_", " ")
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, name), _capital(text))


def _capital(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substring(text, F.lit(2), F.length(text))))


def months_since(date: Column, year: int) -> Column:
    return (F.year(date) - year) * 12 + F.month(date) - 1


def floored_days(later: Column, earlier: Column) -> Column:
    """Whole days elapsed, rounded down (not the difference of calendar days), to the microsecond."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gone, day = micros(later) - micros(earlier), F.lit(86_400_000_000)
    return ((gone - F.pmod(gone, day)) / day).cast("long")


def day_number(date: Column) -> Column:
    return F.unix_date(date.cast("date"))


def utc_naive(text: Column) -> Column:
    """Instant to naive UTC, whatever the session's zone; a text without offset is UTC; null where it can't be read."""
    t = F.trim(text)
    zoned = F.when(t.rlike(r"^\d{4}-\d\d-\d\d$"), F.concat(t, F.lit("T00:00:00Z"))).when(t.rlike(r"(Z|[+-]\d\d(:?\d\d)?)$"), t).otherwise(F.concat(t, F.lit("Z")))
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.try_to_timestamp(zoned).cast("timestamp_ntz"))


def rooms_per_10m2(rooms: Column, surface: Column) -> Column:
    return rooms / F.greatest(surface.cast("double"), F.lit(1.0)) * 10.0


def relative_difference(a: Column, b: Column) -> Column:
    return F.try_divide(F.abs(a - b), b)


def percent_error(predicted: Column, actual: Column) -> Column:
    return F.try_divide(predicted - actual, actual) * 100.0


def log_residual(value: Column, anchor: Column) -> Column:
    return F.ln(F.try_divide(value, anchor))


def from_log_residual(residual: Column, anchor: Column) -> Column:
    return F.exp(residual) * anchor


def clipped(c: Column, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """c within [low, high]; null stays null."""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low) if isinstance(low, (int, float)) else low)
    if high is not None:
        out = F.least(out, F.lit(high) if isinstance(high, (int, float)) else high)
    return F.when(c.isNotNull(), out)


def in_range(c: Column, low: float, high: float) -> Column:
    """c, or null outside [low, high]."""
    return F.when(c.between(low, high), c)


def finite(c: Column) -> Column:
    """c, or null where it is NaN or infinite."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < math.inf), d)


def wilson(successes: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of Wilson's interval; null without observations."""
    n = F.when(total > 0, total.cast("double"))
    p = successes.cast("double") / n
    mid = (p + z * z / (2.0 * n)) / (1.0 + z * z / n)
    half = z * F.sqrt(p * (1.0 - p) / n + z * z / (4.0 * n * n)) / (1.0 + z * z / n)
    return mid - half, mid + half


def banded(c: Column, edges: list[float], labels: list[str], closed: str = "left") -> Column:
    """Fixed bins: [a, b) with closed="left", (a, b] with "right"; null outside."""
    out = None
    for a, b, name in zip(edges[:-1], edges[1:], labels, strict=True):
        inside = (c >= a) & (c < b) if closed == "left" else (c > a) & (c <= b)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def config_text(values: dict[str, Column]) -> Column:
    """JSON object with its keys in order."""
    return F.to_json(F.struct(*[values[k].alias(k) for k in sorted(values)]))
