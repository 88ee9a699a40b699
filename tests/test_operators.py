"""Hand-computed edge cases of the library's operators."""

from __future__ import annotations

import math
import random
from datetime import date, datetime, timedelta
from statistics import median

import pytest
from pyspark.sql import functions as F

from propval.functions import geo, scalar
from propval.operators import asof, cohort, comps, contracts, gridjoin, linkage, ml, polygon, stats, valuation
from propval.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


# scalar functions ---------------------------------------------------------------------------------


def test_zero_fill_never_truncates(spark):
    assert one(spark, scalar.zero_filled(F.lit("12345"), 4)) == "12345"
    assert one(spark, scalar.zero_filled(F.lit("7"), 4)) == "0007"


@pytest.mark.parametrize(("raw", "code"), [("BIS", "b"), ("ter", "t"), (" Quater ", "q"), ("A", "a"), (None, "")])
def test_suffix_codes(spark, raw, code):
    assert one(spark, scalar.suffix_code(F.lit(raw).cast("string"))) == code == valuation.normal_suffix(raw)


def test_address_key(spark):
    key = lambda *a: one(spark, scalar.address_key(*[F.lit(x).cast("string") for x in a]))
    assert key("75108", "2576", "29", "") == "75108_2576_00029"
    assert key("75108", "X2576", "29.0", "B") == "75108_2576_00029_b"
    assert key("75108", None, "29", "") is None and key("75108", "2576", None, "") is None


def test_day_differences_floor_elapsed_time(spark):
    a, b = F.lit(datetime(2021, 1, 2)), F.lit(datetime(2021, 1, 1, 14))
    assert one(spark, scalar.floored_days(a, b)) == 0


def test_day_differences_count_fractions_of_a_second(spark):
    later, earlier = F.lit(datetime(2021, 1, 2, 0, 0, 0, 100_000)), F.lit(datetime(2021, 1, 1, 0, 0, 0, 900_000))  # 0.8 s short of a day
    assert one(spark, scalar.floored_days(later, earlier)) == 0 and one(spark, scalar.floored_days(earlier, later)) == -1


def test_clip_keeps_null(spark):
    assert one(spark, scalar.clipped(F.lit(None).cast("double"), 1.0)) is None
    assert one(spark, scalar.clipped(F.lit(0.5), 1.0)) == 1.0


def test_quoted_tokens(spark):
    got = [one(spark, scalar.quoted_tokens(F.lit(x).cast("string"))) for x in (None, "[]", '["a", "b"]')]
    assert got == [1, 1, 2]


def test_wilson_of_nothing_is_null(spark):
    low, high = scalar.wilson(F.lit(0), F.lit(0))
    assert one(spark, low) is None and one(spark, high) is None
    low, high = scalar.wilson(F.lit(8), F.lit(10))
    assert round(one(spark, low), 4) == 0.4902 and round(one(spark, high), 4) == 0.9433


def test_finite_and_lenient_numbers(spark):
    assert one(spark, scalar.finite(F.lit(math.nan))) is None and one(spark, scalar.finite(F.lit(math.inf))) is None
    assert one(spark, scalar.integer_text(F.lit("007.0"))) == "7" and one(spark, scalar.integer_text(F.lit("x"))) is None
    assert one(spark, scalar.utc_naive(F.lit("2024-03-01T00:30:00+02:00"))) == datetime(2024, 2, 29, 22, 30)
    assert one(spark, scalar.utc_naive(F.lit("never"))) is None


def test_projection_golden_point(spark):
    x, y = geo.lambert93(F.lit(2.302806), F.lit(48.878673))
    px, py = one(spark, x), one(spark, y)
    assert math.hypot(px - 648873.72, py - 6864512.73) == pytest.approx(10.51, abs=0.01)


def test_parsers(spark):
    lon, lat = geo.parse_point(F.lit("48.85, 2.35"))
    assert (one(spark, lon), one(spark, lat)) == (2.35, 48.85)
    assert one(spark, geo.parse_point(F.lit("48.85"))[0]) is None and one(spark, geo.parse_point(F.lit(None).cast("string"))[1]) is None
    assert one(spark, geo.wkt_centroid(F.lit("POLYGON ((0 0, 4 0, 4 2, 0 0))"))[0]) == 2.0
    assert one(spark, geo.wkt_centroid(F.lit("EMPTY"))[0]) is None


def test_cells_are_the_nearest_hexagon(spark):
    for r, m in geo.CELL_METERS.items():
        for x, y in ((1000.0, -1.0), (-733.3, 2500.0), (0.0, 0.0), (654321.0, 6861234.5)):
            got = one(spark, geo.cell(F.lit(x), F.lit(y), r)).split("_")
            far = lambda q, k: (x - m * 3**0.5 * (q + k / 2)) ** 2 + (y - m * 1.5 * k) ** 2
            k0 = round(y / (m * 1.5))
            q0 = round(x / (m * 3**0.5) - k0 / 2)
            assert (int(got[1]), int(got[2])) == min(((q0 + a, k0 + b) for a in (-2, -1, 0, 1, 2) for b in (-2, -1, 0, 1, 2)), key=lambda c: far(*c)) and got[0] == f"c{r}"


def test_comparables_are_measured_by_blocks_and_equal_the_pairs(spark):
    rng = random.Random(5)
    rows = [(i, date(2015, 1, 1) + timedelta(rng.randrange(2200)), rng.choice([None, 7.5, *[rng.uniform(-2500, 2500)] * 20]), rng.uniform(-2500, 2500), rng.choice([None, 40.0, 50.0, 55.0]), rng.choice([None, 1, 2, 3]), rng.choice([None, *[rng.uniform(1000, 9000)] * 9])) for i in range(400)]
    s = spark.createDataFrame(rows, "sale_id int, sale_date date, x double, y double, surface double, rooms int, ppm2 double").persist()
    pairs = {}
    for r in comps.candidates(s, s).collect():
        pairs.setdefault(r.sale_id, []).append(r)
    features = comps.all_features(s, s)
    assert "Join" not in features._jdf.queryExecution().executedPlan().toString()  # no pairs on disk
    got = {r.sale_id: r for r in features.collect()}
    assert len(got) == len(rows) and len(pairs) > 100
    for i, r in got.items():
        mine = pairs.get(i, [])
        for radius, days in comps.WINDOWS:
            p = [c.p for c in mine if c.d <= radius and c.age <= days]
            assert r[f"local_{days}d_{radius}m_count"] == len(p) and r[f"local_{days}d_{radius}m_median_ppm2"] == (pytest.approx(median(p)) if p else None)
        p = [c.p for c in mine if c.d <= 500 and c.age <= 365]
        assert r.local_365d_500m_mad_ppm2 == (pytest.approx(median([abs(v - median(p)) for v in p])) if p else None)
        assert r.nearest_prior_sale_m == (pytest.approx(min(c.d for c in mine)) if mine else None) and r.median_comparable_age_days == (median([c.age for c in mine]) if mine else None)
        w = [math.exp(-c.d / 350 - (c.age - 90) / 240) for c in mine]
        assert r.weighted_comp_ppm2 == (pytest.approx(sum(a * c.p for a, c in zip(w, mine, strict=True)) / sum(w)) if mine else None)
        alike = [(a * math.exp(-abs(math.log(c.s / c.surface)) / 0.25), c.p) for a, c in zip(w, mine, strict=True) if c.s and c.surface and 0.7 <= c.s / c.surface <= 1.3 and (c.rooms is None or c.r is None or abs(c.r - c.rooms) <= 1)]
        assert r.similar_comparable_count == (len(alike) or None) and r.similar_weighted_comp_ppm2 == (pytest.approx(sum(a * b for a, b in alike) / sum(a for a, _ in alike)) if alike else None)


def test_dense_comparables_are_counted_as_sets_in_parts(monkeypatch):
    """Windows as sets of bits, in several parts of days, places and targets, equal plain slices; also repeated and odd values."""
    import numpy as np
    import pandas as pd

    for name, size in (("MASKS_AT_ONCE", 150_000), ("PLACES_AT_ONCE", 5_000), ("WORDS_AT_ONCE", 100)):
        monkeypatch.setattr(comps, name, size)
    rng = np.random.default_rng(3)
    n = 3000
    h = pd.DataFrame({"r_x": rng.integers(-60, 60, n) * 20.0, "r_y": rng.integers(-60, 60, n) * 20.0, "r_day": rng.integers(0, 1500, n), "p": rng.choice([rng.normal(0, 5), 7.0, -1e9, 1e9], n) + rng.integers(0, 40, n), "s": 50.0, "r": 2.0})
    t = pd.DataFrame({"sale_id": range(300), "x": rng.integers(-6, 6, 300) * 20.0, "y": rng.integers(-6, 6, 300) * 20.0, "day": rng.integers(0, 1500, 300), "surface": 50.0, "rooms": 2.0})
    one = (500, 365)
    columns = [*comps.GATHERED, *[f"{comps.name_of(w)}_{c}" for w in comps.WINDOWS for c in ("count", "median_ppm2")], f"{comps.name_of(one)}_mad_ppm2"]
    got = comps.measure_block(t, h, columns, 90, (1000, 730), comps.WINDOWS, True, one)
    counts = comps.measure_block(t, h, [c for c in columns if c.endswith("_count")], 90, (1000, 730), comps.WINDOWS, False, None)
    for i, r in t.iterrows():
        d, age = np.hypot(h.r_x - r.x, h.r_y - r.y), r.day - h.r_day
        near = (d <= 1000) & (age >= 90) & (age <= 730)
        assert np.array_equal([got[c][i] for c in comps.GATHERED], [d[near].min(), age[near].median()], equal_nan=True)
        for w in comps.WINDOWS:
            p = h.p[near & (d <= w[0]) & (age <= w[1])]
            assert got[f"{comps.name_of(w)}_count"][i] == counts[f"{comps.name_of(w)}_count"][i] == len(p)
            assert np.array_equal(got[f"{comps.name_of(w)}_median_ppm2"][i], p.median(), equal_nan=True)
            if w == one:
                assert np.array_equal(got[f"{comps.name_of(w)}_mad_ppm2"][i], (p - p.median()).abs().median(), equal_nan=True)


def test_dense_weights_look_at_similar_sales_alone(monkeypatch):
    """Similar sales come from slices by rooms and surface, in several parts, with unknown, zero and odd values; all equal plain sums."""
    import numpy as np
    import pandas as pd

    monkeypatch.setattr(comps, "MASKS_AT_ONCE", 100_000)
    monkeypatch.setattr(comps, "PLACES_AT_ONCE", 5_000)
    monkeypatch.setattr(comps, "FEW", 20)
    plain, looked = np.unpackbits, []
    monkeypatch.setattr(np, "unpackbits", lambda a, **k: looked.append(a.size * 8) or plain(a, **k))
    rng, nan = np.random.default_rng(4), np.nan
    n, few = 4000, 200
    h = pd.DataFrame({"r_x": rng.integers(-60, 60, n) * 20.0, "r_y": rng.integers(-60, 60, n) * 20.0, "r_day": rng.integers(0, 1500, n), "p": rng.uniform(1e3, 9e3, n), "s": rng.choice([nan, 0.0, -40.0, np.inf, *range(20, 140, 5)], n), "r": rng.choice([nan, *range(1, 8)], n)})
    t = pd.DataFrame({"sale_id": range(few), "x": rng.integers(-6, 6, few) * 20.0, "y": rng.integers(-6, 6, few) * 20.0, "day": rng.integers(0, 1500, few), "surface": rng.choice([nan, 0.0, -40.0, 50.0, 70.0, 100.0], few), "rooms": rng.choice([nan, 2.0, 4.0, 6.5], few)})
    got = comps.measure_block(t, h, list(comps.WEIGHTED), 90, (1000, 730), (), True, None)
    for i, r in t.iterrows():
        d, age = np.hypot(h.r_x - r.x, h.r_y - r.y), r.day - h.r_day
        near = (d <= 1000) & (age >= 90) & (age <= 730)
        w = np.exp(-d / 350 - (age - 90) / 240)[near]
        want = [np.dot(w, h.p[near]) / w.sum(), w.sum() ** 2 / np.dot(w, w)] if near.any() else [nan, nan]
        with np.errstate(all="ignore"):
            ratio = h.s[near] / r.surface
        alike = (ratio >= 0.7) & (ratio <= 1.3) & ~(np.abs(h.r[near] - r.rooms) > 1)
        c = w[alike] * np.exp(-np.abs(np.log(ratio[alike])) / 0.25)
        want += [alike.sum(), np.dot(c, h.p[near][alike]) / c.sum()] if alike.any() else [nan, nan]
        assert np.allclose([got[k][i] for k in comps.WEIGHTED], want, rtol=1e-12, equal_nan=True), (i, r)
    assert 0 < sum(looked) < few * n / 3  # far fewer than all pairs


def test_a_lone_comparable_is_weighed_as_in_the_sql():
    """w * p / w is not always p, which shows where p lies between two rounded values: the weight has the SQL's bits."""
    import numpy as np
    import pandas as pd

    for k in range(1, 200):
        d, age, p = 3.0 * k, 90 + 3 * k, 3040.1871875 + k
        h = pd.DataFrame({"r_x": [d, 3000.0], "r_y": 0.0, "r_day": [1000 - age, 995], "p": [p, 1.0], "s": 48.0, "r": 2.0})
        t = pd.DataFrame({"sale_id": [1], "x": [0.0], "y": [0.0], "day": [1000], "surface": [50.0], "rooms": [2.0]})
        got = comps.measure_block(t, h, list(comps.WEIGHTED), 90, (1000, 730), (), True, None)
        if age <= 730:
            w = (np.exp(np.array([-d / 350.0])) * np.exp(np.array([-(age - 90) / 240.0])))[0]
            assert got.weighted_comp_ppm2[0] == w * p / w
            assert got.similar_weighted_comp_ppm2[0] == pytest.approx(p, rel=1e-15)


def test_comparable_quality_weighs_nothing(spark, monkeypatch):
    """The counts tell where there is a weighted comparable; the weights themselves are not worked out."""
    s = spark.createDataFrame([(i, date(2020, 1, 1) + timedelta(days=200 * i), 0.0, 1000.0 * (i == 3), 50.0, 2.0, 9.0) for i in range(5)], "sale_id int, sale_date date, x double, y double, surface double, rooms double, ppm2 double")
    found = comps.coverage(s, s)
    assert "weighted_comp_ppm2" not in found.columns
    whole = {r.sale_id: r.weighted_comp_ppm2 is not None for r in comps.all_features(s, s).collect()}
    assert {r.sale_id: r.covered for r in found.collect()} == whole and not whole[0] and whole[4]


def test_cells_of_points_between_two_centres_are_the_smaller(spark):
    m = geo.CELL_METERS[8]
    for k in (-3, -1, 1, 5):  # x = 0 is as far from (q, k) as from (q + 1, k)
        for off in (-200.0, 10.0):
            assert one(spark, geo.cell(F.lit(0.0), F.lit(m * 1.5 * k + off), 8)) == f"c8_{(-k - 1) // 2}_{k}"


# joins -----------------------------------------------------------------------------------------------


def test_range_join_equals_brute_force(spark):
    rng = random.Random(2)
    pts = [(i, rng.uniform(-3000, 3000), rng.uniform(-3000, 3000), rng.randrange(1500)) for i in range(200)] + [(200, 0.0, 0.0, 800), (201, 300.0, 400.0, 710), (202, 0.0, 500.0, 711)]
    left = spark.createDataFrame(pts, "i int, x double, y double, day int")
    right = left.toDF("j", "r_x", "r_y", "r_day")
    got = {(r.i, r.j) for r in gridjoin.within(left, right, 500.0, "day", "r_day", 90, 730).collect()}
    want = {(a[0], b[0]) for a in pts for b in pts if math.hypot(a[1] - b[1], a[2] - b[2]) <= 500 and 90 <= a[3] - b[3] <= 730}
    assert got == want and (200, 201) in got and (200, 202) not in got


def test_nearest_and_radius(spark):
    t = spark.createDataFrame([(1, 0.0, 0.0), (2, 90000.0, 0.0), (3, None, 0.0)], "k int, x double, y double")
    p = spark.createDataFrame([(3.0, 4.0, 2.0), (None, 0.0, 5.0), (500.0, 0.0, 1.0)], "x double, y double, w double")
    got = {r.k: r.distance_m for r in gridjoin.nearest(t, p, "k").collect()}
    assert got[1] == 5.0 and got[2] == 89500.0 and got[3] is None
    assert {r.k: r.distance_m for r in gridjoin.nearest(t, p.limit(0), "k").collect()} == {1: None, 2: None, 3: None}
    got = {r.k: (r.n_points, r.weight_sum) for r in gridjoin.radius_aggregate(t, p, "k", 500.0, "w").collect()}
    assert got == {1: (2, 3.0), 2: (0, 0.0), 3: (0, 0.0)}


def test_radius_aggregate_equals_brute_force_and_makes_no_pairs(spark, monkeypatch):
    """Dense and sparse places, points on the circle, repeated targets, odd weights and coordinates; never through a join of pairs."""
    monkeypatch.setattr(gridjoin, "within", None)
    rng = random.Random(8)
    inf, nan = math.inf, math.nan
    for n, wide, radius in ((3000, 900.0, 250.0), (60, 90000.0, 400.0), (400, 20.0, 250.0)):
        pts = [(float(rng.randrange(int(wide))), rng.uniform(-wide, wide), float(rng.randrange(-50, 50))) for _ in range(n)]
        pts += [(300.0, 400.0, 7.0), (0.0, radius, 3.0), (-radius, 0.0, None), (None, 1.0, 5.0), (nan, 1.0, 5.0), (inf, 1.0, 5.0)]
        own = [(i, rng.uniform(0, wide), rng.uniform(-wide, wide)) for i in range(150)] + [(150, 0.0, 0.0), (151, -0.0, 0.0), (152, None, 0.0), (153, nan, 0.0), (154, inf, 1.0), (155, 1e7, 1e7)]
        t, p = spark.createDataFrame(own, "k int, x double, y double"), spark.createDataFrame(pts, "x double, y double, w double").repartition(3)
        got = {r.k: (r.n_points, r.weight_sum) for r in gridjoin.radius_aggregate(t, p, "k", radius, "w").collect()}
        assert len(got) == len(own)
        for k, x, y in own:
            near = [w or 0.0 for a, b, w in pts if None not in (a, x) and math.hypot(x - a, y - b) <= radius and math.isfinite(x)]
            assert got[k] == (len(near), sum(near)), k
    odd = spark.createDataFrame([(0.0, 0.0, nan), (100.0, 0.0, inf), (200.0, 0.0, 1.0)], "x double, y double, w double")
    at = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0), (3, 200.0, 0.0)], "k int, x double, y double")
    got = {r.k: r.weight_sum for r in gridjoin.radius_aggregate(at, odd, "k", 50.0, "w").collect()}
    assert math.isnan(got[1]) and got[2] == inf and got[3] == 1.0
    assert [r.n_points for r in gridjoin.radius_aggregate(at, odd.limit(0), "k", 50.0).collect()] == [0, 0, 0]


def test_polygons(spark):
    sq = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    polys = spark.createDataFrame([(1, 55, sq(0.0, 3000.0)), (2, 70, sq(500.0, 900.0)), (3, 99, [(0.0, 0.0), (9.0, 9.0)])], "poly_id int, level int, ring array<struct<x:double,y:double>>")
    pts = spark.createDataFrame([(1, 600.0, 600.0), (2, 2000.0, 100.0), (3, -5.0, 5.0), (4, None, 1.0)], "k int, x double, y double")
    assert {r.k: r.level for r in polygon.max_level(pts, polygon.edges_of(polys), "k").collect()} == {1: 70, 2: 55, 3: None, 4: None}


def test_asof_ties_and_nulls(spark):
    probes = spark.createDataFrame([(1, "a", 10), (2, "a", 9), (3, "b", 5), (4, None, 10), (5, "a", 3)], "id int, k string, t int")
    recs = spark.createDataFrame([("a", 10, 1, "x"), ("a", 10, 2, "y"), ("a", 4, 3, "z"), ("b", 6, 4, "late"), (None, 1, 5, "null")], "k string, rt int, rid int, v string")
    got = {r.id: r.v for r in asof.latest(probes, recs, "k", "t", "rt", "rid", ["v"]).collect()}
    assert got == {1: "y", 2: "z", 3: None, 4: None, 5: None}


def sales(spark, rows):
    return spark.createDataFrame([(i, d, x, 0.0, s, r, p) for i, d, x, s, r, p in rows], "sale_id int, sale_date date, x double, y double, surface double, rooms double, ppm2 double")


def test_comparables_by_hand(spark):
    from datetime import timedelta

    day = date(2022, 6, 1)
    rows = [(0, day, 0.0, 50.0, 2.0, 9000.0)]
    for k, (age, x, s, r, p) in enumerate([(89, 1, 50, 2, 1.0), (90, 250, 50, 2, 8000.0), (365, 500, 65, 3, 10000.0), (366, 500, 66, 2, 12000.0), (730, 1000, 50, 4, 9000.0), (731, 0, 50, 2, 1.0), (100, 1000.5, 50, 2, 1.0), (120, 100, 50, None, None)], 1):
        rows.append((k, day - timedelta(days=age), float(x), float(s), r if r is None else float(r), p))
    s = sales(spark, rows)
    r = comps.all_features(s.where("sale_id = 0"), s).first()
    assert (r.nearest_prior_sale_m, r.median_comparable_age_days) == (250.0, 365.5)
    assert (r.local_365d_250m_count, r.local_365d_500m_count, r.local_730d_500m_count, r.local_730d_1000m_count, r.local_180d_500m_count) == (1, 2, 3, 4, 1)
    assert r.local_365d_500m_median_ppm2 == 9000.0 and r.local_365d_500m_mad_ppm2 == 1000.0 and r.similar_comparable_count == 2
    w = [math.exp(-d / 350) * math.exp(-(a - 90) / 240) for d, a in ((250, 90), (500, 365), (500, 366), (1000, 730))]
    assert r.weighted_comp_ppm2 == pytest.approx(sum(a * b for a, b in zip(w, (8000, 10000, 12000, 9000))) / sum(w))
    assert r.effective_comparable_count == pytest.approx(sum(w) ** 2 / sum(x * x for x in w))
    assert r.momentum_500m == pytest.approx(8000 / 9000 - 1)
    none = comps.all_features(s.where("sale_id = 6"), s).first()
    assert none.local_365d_500m_count == 0 and none.weighted_comp_ppm2 is None and none.similar_comparable_count is None
    with pytest.raises(ValueError):
        comps.candidates(s, s, lag=0)


def test_one_best_and_confidence(spark):
    rel = spark.createDataFrame([(1, 5, None), (1, 6, 2.0), (None, 7, 9.0), (2, 9, 1.0), (2, 8, 1.0)], "a int, b int, rel double")
    got = {r.a: r.b for r in linkage.one_best(rel, "a", [F.col("rel").desc_nulls_last(), F.col("b")]).collect()}
    assert got == {1: 6, 2: 8}
    df = spark.createDataFrame([(1, 5, 9, 15.0, 1, 1), (2, 5, 9, None, 1, 1), (3, None, 9, None, 0, 1), (4, None, 9, None, 0, 2), (5, None, None, None, 0, 0)], "i int, a int, p int, r double, na int, np int")
    got = {r.i: (r.building_id, r.match_method, r.match_confidence) for r in linkage.resolve_buildings(df, "a", "p", "r", "na", "np").collect()}
    assert got == {1: (5, "address_relation", 1.0), 2: (5, "address_relation", 0.8), 3: (9, "principal_parcel", 0.7), 4: (9, "principal_parcel", 0.5), 5: (None, "unmatched", 0.0)}


def test_keep_last_prefers_null_years(spark):
    df = spark.createDataFrame([(1, 2015, "a"), (1, None, "b"), (2, 2015, "c"), (2, 2016, "d")], "k int, y int, v string")
    assert {r.k: r.v for r in readers.latest_by(df, ["k"], F.col("y")).collect()} == {1: "b", 2: "d"}


# cohort -------------------------------------------------------------------------------------------------


def test_clean_sales(spark):
    cols = "id_mutation string, nature_mutation string, date_mutation string, code_type_local string, valeur_fonciere double, surface_reelle_bati double, code_postal string, latitude double, longitude double"
    ok = ("Vente", "2022-05-06", "2", 400000.0, 40.0, "75011", 48.85, 2.37)
    rows = [
        ("good", *ok), ("house", *ok), ("house", "Vente", "2022-05-06", "1", *ok[3:]), ("two", *ok), ("two", *ok), ("small", *ok[:4], 8.99, *ok[5:]), ("edge", "Vente", "2022-05-06", "2", 50000.0, 9.0, "75020", 48.80, 2.20),
        ("zip", *ok[:5], "75021", *ok[6:]), ("gift", "Don", *ok[1:]), ("nodate", "Vente", "x", *ok[2:]), (None, *ok),
    ]
    got = {r.id_mutation: r for r in cohort.clean_sales(spark.createDataFrame(rows, cols)).collect()}
    assert set(got) == {"good", "edge"} and got["good"].price_per_m2 == 10000.0 and got["good"].months_since_2021 == 16


def test_year_split_needs_rows(spark):
    df = spark.createDataFrame([(2023,), (2024,), (2025,)], "y int")
    assert cohort.year_split(df, "y", 2023, 2024, 2025, minimum=1)["final_train"].count() == 2
    with pytest.raises(ValueError):
        cohort.year_split(df, "y", 2023, 2024, 2025)


# contracts -------------------------------------------------------------------------------------------------


def test_contracts(spark):
    a = spark.createDataFrame([(1, 1, "f"), (2, 2, "f")], "id int, d int, src string")
    twice = a.union(a)
    contracts.unique(a, "id"), contracts.same_rows(a, a, "id"), contracts.chronological(a, "id", "d"), contracts.at_least(a, 2, "a"), contracts.columns(a, ["id"])
    contracts.no_overlap(a, "id", "src"), contracts.no_future(a, "d", "id"), contracts.many_to_one(a, "id")
    bad = [
        lambda: contracts.unique(twice, "id"), lambda: contracts.same_rows(a, twice, "id"), lambda: contracts.same_rows(a, a.limit(1), "id"), lambda: contracts.at_least(a, 3, "a"), lambda: contracts.columns(a, ["no"]),
        lambda: contracts.chronological(spark.createDataFrame([(1, 2), (2, 1)], "id int, d int"), "id", "d"), lambda: contracts.chronological(spark.createDataFrame([(1, 5), (100001, 4)], "id int, d int"), "id", "d"),
        lambda: contracts.no_overlap(a.union(a.withColumn("src", F.lit("g"))), "id", "src"), lambda: contracts.no_future(a.withColumn("d", F.lit(9)), "d", "id"), lambda: contracts.close_to(0, 0, 300, 0), lambda: contracts.many_to_one(twice, "id"),
    ]
    for f in bad:
        with pytest.raises(contracts.ContractError):
            f()
    assert contracts.close_to(648873.72, 6864512.73, 648866.60, 6864520.34) < 25
    assert contracts.report(a.withColumn("n", F.lit(None).cast("int")))["missing"] == {"id": 0.0, "d": 0.0, "src": 0.0, "n": 1.0}


# statistics --------------------------------------------------------------------------------------------------


def test_quantile_bins_merge_equal_edges(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 1.0, 1.0, 1.0, 2.0, 3.0, None)], "v double")
    got = sorted(((r.v, r.bin) for r in stats.quantile_bins(df, "v", 4).collect()), key=str)
    assert got == [(1.0, 0)] * 4 + [(2.0, 2), (3.0, 2)] + [(None, None)] or got[:4] == [(1.0, 0)] * 4


def test_simplex_and_weights():
    grid = stats.simplex(3)
    assert len(grid) == 66 and all(sum(w) == 10 and min(w) >= 0 for w in grid) and len(set(grid)) == 66


def test_nearest_starts_with_small_rings_among_many_points(spark, monkeypatch):
    radii, real = [], gridjoin.within
    monkeypatch.setattr(gridjoin, "within", lambda a, b, r: radii.append(r) or real(a, b, r))
    p = spark.range(2500).select((F.col("id") % 50 * 10).cast("double").alias("x"), (F.floor(F.col("id") / 50) * 10).cast("double").alias("y"))
    t = spark.createDataFrame([(1, 3.0, 4.0), (2, 900.0, 490.0), (3, None, 0.0)], "k int, x double, y double")
    assert {r.k: r.distance_m for r in gridjoin.nearest(t, p, "k").collect()} == {1: 5.0, 2: 410.0, 3: None}
    assert radii[0] < 50 and radii[-1] == 500.0


def test_bootstrap_rows_are_spread_over_all_partitions(spark):
    df = spark.range(4000, numPartitions=1).select("id", F.col("id").cast("double").alias("e"))
    plan = stats.bootstrap_mae(df, "id", ["e"], 8)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan  # else the planner puts a small table's repetitions into one task


def test_poisson_weights_have_mean_one(spark):
    w = spark.range(20000).select(stats.poisson_weight(F.md5(F.col("id").cast("string")), 3).alias("w"))
    r = w.agg(F.avg("w"), F.var_pop("w")).first()
    assert abs(r[0] - 1) < 0.03 and abs(r[1] - 1) < 0.05


# models and valuation ---------------------------------------------------------------------------------------------


def test_models_recover_a_price_surface(spark):
    rows = [(i, 2018 + i % 3, float(20 + i % 80), ["a", "b"][i % 2], (20 + i % 80) * (5000.0 if i % 2 else 7000.0)) for i in range(600)] + [(600, 2020, None, "new", 300000.0)]
    df = spark.createDataFrame(rows, "id int, y int, surface double, seg string, price double").withColumn("anchor", F.when(F.col("id") % 5 > 0, 6000.0))
    train, test = df.where("y < 2020"), df.where("y = 2020")
    spec = ml.Spec(["surface"], ["seg"], target="ppm2")
    fitted = ml.fit("ridge", {"alpha": 0.1}, train, spec)
    out = ml.predict(fitted, test)
    assert ml.mae(out.where("id < 600"), "price", "prediction") < 5000
    assert ml.predict(ml.fit("boosted", {"maxIter": 3, "maxDepth": 3}, train, ml.Spec(["surface"], ["seg"], target="residual")), test).where("anchor IS NULL AND prediction IS NOT NULL").count() == 0
    forest = ml.fit("forest", {"numTrees": 3, "maxDepth": 3}, train, ml.Spec(["surface"], ["seg"]))
    gains = ml.gain_importance(forest)
    assert {n for n, _ in gains} == {"surface", "seg"} and sum(v for _, v in gains) == pytest.approx(1.0)


def test_valuation_domain_and_blend():
    ok = valuation.Property(0.0, 0.0, 58.0, 3, date(2025, 1, 2), "75008", "75108", "2576", 29)
    assert valuation.normal_address(valuation.validated(ok)) == "75108_2576_29_"
    for field, value in (("surface", 8.0), ("surface", 301.0), ("postal_code", "75021"), ("commune", "75008"), ("street_code", "25"), ("rooms", 0), ("asking_price", -1.0)):
        with pytest.raises(ValueError):
            valuation.validated(valuation.Property(**{**ok.__dict__, field: value}))
    assert valuation.blended(100.0, None, 10.0, 0.75) == 100.0 and valuation.blended(100.0, 20.0, 10.0, 0.75) == 125.0


def test_bootstraps_repeat_as_often_as_the_reference_by_default():
    import inspect

    of = lambda f: inspect.signature(f).parameters["repetitions"].default
    assert of(stats.bootstrap_intervals) == 500 and of(stats.paired_bootstrap) == 1_000
