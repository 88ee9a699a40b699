"""SQL oracles, independent of the operators: brute-force joins, ray casting, ASOF, quantile_cont."""

from __future__ import annotations

from propval.functions.scalar import LABELS
from propval.operators.comps import WINDOWS
from propval.operators.ml import all_features
from propval.operators.stats import simplex

SALE = """sale AS (SELECT o.o_orderkey AS sale_id, CAST(o.o_orderdate AS DATE) AS sale_date, CAST(year(o.o_orderdate) AS INTEGER) AS sale_year,
  c.c_mktsegment AS segment, c.c_nationkey AS area, CAST(o.o_totalprice AS DOUBLE) AS price, CAST(l.qty AS DOUBLE) AS surface, l.n_lines AS rooms,
  CAST(o.o_totalprice AS DOUBLE) / CAST(l.qty AS DOUBLE) AS ppm2, CAST(o.o_custkey * 37 % 10007 AS DOUBLE) AS x, CAST(o.o_custkey * 101 % 9973 AS DOUBLE) AS y
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN (SELECT l_orderkey, SUM(l_quantity) AS qty, COUNT(*) AS n_lines FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey)"""
PRED = SALE + """, pred AS (SELECT sale_id, sale_date, sale_year, segment, area, surface, price,
  price * (CAST(0.8 AS DOUBLE) + CAST(sale_id * 37 % 41 AS DOUBLE) / CAST(100 AS DOUBLE)) AS pred_a,
  price * (CAST(0.7 AS DOUBLE) + CAST(sale_id * 53 % 61 AS DOUBLE) / CAST(100 AS DOUBLE)) AS pred_b FROM sale),
  test AS (SELECT * FROM pred WHERE sale_year = 2000), cal AS (SELECT *, price / pred_b AS ratio FROM pred WHERE sale_year = 1999)"""
POI = "poi AS (SELECT s_suppkey AS poi_id, s_suppkey % 4 AS mode, CAST(s_acctbal AS DOUBLE) AS weight, CAST(s_suppkey * 7919 % 10007 AS DOUBLE) AS x, CAST(s_suppkey * 1049 % 9973 AS DOUBLE) AS y FROM supplier)"
POLY = """poly AS (SELECT n_nationkey AS poly_id, CAST(55 + 5 * (n_nationkey % 4) AS BIGINT) AS level, CAST(n_nationkey * 397 % 9000 + 500 AS DOUBLE) AS cx, CAST(n_nationkey * 811 % 9000 + 500 AS DOUBLE) AS cy FROM nation),
  edge AS (SELECT poly_id, level, CASE k WHEN 0 THEN cx-800 WHEN 1 THEN cx+800 ELSE cx END AS x1, CASE k WHEN 2 THEN cy+900 ELSE cy-800 END AS y1,
  CASE k WHEN 0 THEN cx+800 WHEN 1 THEN cx ELSE cx-800 END AS x2, CASE k WHEN 1 THEN cy+900 ELSE cy-800 END AS y2 FROM poly CROSS JOIN (SELECT unnest([0, 1, 2]) AS k)),
  inside AS (SELECT s.sale_id, e.poly_id, e.level FROM sale s CROSS JOIN edge e WHERE (e.y1 > s.y) <> (e.y2 > s.y) AND s.x < (e.x2 - e.x1) * (s.y - e.y1) / (e.y2 - e.y1) + e.x1 GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1),
  levels AS (SELECT s.sale_id, max(i.level) AS level FROM sale s LEFT JOIN inside i USING (sale_id) GROUP BY 1)"""
CAND = """cand AS (SELECT s.sale_id, sqrt((s.x - h.x) * (s.x - h.x) + (s.y - h.y) * (s.y - h.y)) AS d, CAST(s.sale_date - h.sale_date AS DOUBLE) AS age, h.ppm2 AS p, h.surface AS s, CAST(h.rooms AS DOUBLE) AS r,
  s.surface AS ts, CAST(s.rooms AS DOUBLE) AS tr FROM sale s JOIN sale h ON h.sale_date <= s.sale_date - 90 AND h.sale_date >= s.sale_date - 730
  AND h.x BETWEEN s.x - 1000 AND s.x + 1000 AND h.y BETWEEN s.y - 1000 AND s.y + 1000
  AND (s.x - h.x) * (s.x - h.x) + (s.y - h.y) * (s.y - h.y) <= 1000000 WHERE h.ppm2 IS NOT NULL)"""
WEIGHTS = """w AS (SELECT *, exp(-d / CAST(350 AS DOUBLE)) * exp(-(age - 90) / CAST(240 AS DOUBLE)) AS w,
  coalesce(s / ts BETWEEN 0.7 AND 1.3, false) AND (tr IS NULL OR r IS NULL OR abs(r - tr) <= 1) AS sim FROM cand)"""


def _windows() -> str:
    cols = ["round(min(d), 4) AS nearest_prior_sale_m", "round(median(age), 4) AS median_comparable_age_days"]
    for r, t in WINDOWS:
        on = f"d <= {r} AND age <= {t}"
        cols += [f"count(*) FILTER (WHERE {on}) AS c_{t}_{r}", f"median(p) FILTER (WHERE {on}) AS m_{t}_{r}"]
    out = ["sale_id", "nearest_prior_sale_m", "median_comparable_age_days"]
    for r, t in WINDOWS:
        out += [f"coalesce(c_{t}_{r}, 0) AS local_{t}d_{r}m_count", f"round(m_{t}_{r}, 4) AS local_{t}d_{r}m_median_ppm2"]
    out += [f"round(m_180_{r} / m_365_{r} - 1, 4) AS momentum_{r}m" for r in (500, 1000)]
    return f"WITH {SALE}, {CAND}, agg AS (SELECT sale_id, {', '.join(cols)} FROM cand GROUP BY sale_id) SELECT {', '.join(out)} FROM sale LEFT JOIN agg USING (sale_id)"


def _metrics(model: str) -> str:
    e, q = f"abs({model} - price)", f"abs(({model} - price) / price) * 100"
    return f"""count(*) AS n, round_even(avg({e}), 2) AS mae, round_even(sqrt(avg({e} * {e})), 2) AS rmse,
      round_even(1 - sum({e} * {e}) / (sum(price * price) - sum(price) * sum(price) / count(price)), 4) AS r2, round_even(avg({q}), 2) AS mape, round_even(median({q}), 2) AS mdape,
      round_even(avg(CAST({q} <= 10 AS DOUBLE)), 4) AS within_10, round_even(avg(CAST({q} <= 20 AS DOUBLE)), 4) AS within_20"""


LON, LAT = "(2.2::DOUBLE + (c_custkey * 37 % 1000) * 0.00028::DOUBLE)", "(48.8::DOUBLE + (c_custkey * 101 % 1000) * 0.00012::DOUBLE)"
N, C, YS, E = "0.7256077650532695::DOUBLE", "11754255.426096::DOUBLE", "12655612.049876::DOUBLE", "0.08181919104281579::DOUBLE"


def _l93(lon: str, lat: str) -> tuple[str, str]:
    p = f"radians({lat})"
    r = f"({C} * pow(tan(pi() / 4 - {p} / 2) / pow((1 - {E} * sin({p})) / (1 + {E} * sin({p})), {E} / 2), {N}))"
    g = f"(radians({lon} - 3.0::DOUBLE) * {N})"
    return f"({r} * sin({g}) + 700000)", f"({YS} - {r} * cos({g}))"


def _hexagons(r: int, m: float) -> str:
    """The nearest of all centres within reach, by brute force."""
    x, y = f"({m}::DOUBLE * sqrt(3) * (q + r / 2.0::DOUBLE))", f"({m}::DOUBLE * 1.5::DOUBLE * r)"
    return f"""c{r} AS (SELECT sale_id, 'c{r}_' || q || '_' || r AS cell_r{r} FROM (SELECT sale_id, x, y, r, CAST(round(x / ({m}::DOUBLE * sqrt(3)) - r / 2.0::DOUBLE) AS BIGINT) + dq AS q
      FROM (SELECT sale_id, x, y, CAST(round(y / ({m}::DOUBLE * 1.5::DOUBLE)) AS BIGINT) + dr AS r FROM sale CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dr)) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dq))
      QUALIFY row_number() OVER (PARTITION BY sale_id ORDER BY (x - {x}) ** 2 + (y - {y}) ** 2, q, r) = 1)"""


def _poisson() -> str:
    import math

    p, total, parts = math.exp(-1), 0.0, []
    for k in range(8):
        total += p
        parts.append((k + 1, total))
        p /= k + 1
    u = "(CAST(('0x' || substr(md5((rep // 4) || '|' || sale_id), 8 * (rep % 4) + 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"
    return "CASE " + " ".join(f"WHEN {u} >= {t!r}::DOUBLE THEN {k}" for k, t in reversed(parts)) + " ELSE 0 END"


def _reps(n: int) -> str:
    return f"""{PRED}, err AS (SELECT sale_id, abs(pred_a - price) AS a, abs(pred_b - price) AS b FROM test),
      rw AS (SELECT rep, a, b, {_poisson()} AS w FROM err CROSS JOIN (SELECT unnest(range({n})) AS rep)),
      reps AS (SELECT rep, sum(a * w) / sum(w) AS a, sum(b * w) / sum(w) AS b FROM rw GROUP BY rep)"""


RESOLVED = f"""{SALE}, rel AS (SELECT l_orderkey AS addr, l_suppkey AS building, CAST(l_quantity AS DOUBLE) AS reliability, l_linenumber AS tie FROM lineitem),
  best AS (SELECT addr, building, reliability FROM rel QUALIFY row_number() OVER (PARTITION BY addr ORDER BY reliability DESC NULLS LAST, tie, building) = 1),
  na AS (SELECT addr, count(*) AS n_address FROM rel GROUP BY 1),
  par AS (SELECT s_nationkey AS area, s_suppkey AS building FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY coalesce(CAST(s_acctbal AS DOUBLE), 0) DESC, s_suppkey) = 1),
  np AS (SELECT s_nationkey AS area, count(*) AS n_parcel FROM supplier GROUP BY 1),
  res AS (SELECT s.sale_id, coalesce(b.building, p.building) AS building_id, CASE WHEN b.building IS NOT NULL THEN 'address_relation' WHEN p.building IS NOT NULL THEN 'principal_parcel' ELSE 'unmatched' END AS match_method,
    CAST(CASE WHEN b.building IS NOT NULL AND b.reliability >= 15 AND na.n_address = 1 THEN 1.0 WHEN b.building IS NOT NULL THEN 0.8 WHEN p.building IS NOT NULL AND np.n_parcel = 1 THEN 0.7 WHEN p.building IS NOT NULL THEN 0.5 ELSE 0.0 END AS DOUBLE) AS match_confidence,
    coalesce(na.n_address, 0) AS n_address, coalesce(np.n_parcel, 0) AS n_parcel
    FROM sale s LEFT JOIN best b ON b.addr = s.sale_id LEFT JOIN na ON na.addr = s.sale_id LEFT JOIN par p ON p.area = s.area LEFT JOIN np ON np.area = s.area)"""
ASOF = """probe AS (SELECT event_id AS probe_id, user_id AS building, ts AS probe_ts, CAST(value AS DOUBLE) AS value FROM events WHERE event_type = 'purchase'),
  diag AS (SELECT event_id AS diag_id, user_id AS building, ts AS diag_ts, CAST(value AS DOUBLE) AS score FROM events WHERE event_type = 'signup'),
  j AS (SELECT p.*, d.diag_id, d.diag_ts, d.score, CAST(floor((epoch(p.probe_ts) - epoch(d.diag_ts)) / 86400) AS BIGINT) AS age_days
    FROM probe p ASOF LEFT JOIN (SELECT * FROM diag QUALIFY row_number() OVER (PARTITION BY building, diag_ts ORDER BY diag_id DESC) = 1) d ON p.building = d.building AND p.probe_ts >= d.diag_ts)"""
NAMES = "names AS (SELECT n_nationkey, (['local_', 'dpe_', 'building_', 'distance_metro_', 'x_', 'ban_'])[n_nationkey % 6 + 1] || lower(n_name) AS name FROM nation)"
FAMILY = """CASE WHEN name LIKE 'local\\_%' ESCAPE '\\' THEN 'Historical comparables' WHEN name LIKE 'dpe\\_%' ESCAPE '\\' THEN 'DPE / energy' WHEN name LIKE 'building\\_%' ESCAPE '\\' OR name LIKE 'ban\\_%' ESCAPE '\\' THEN 'Building / linkage'
  WHEN name LIKE 'distance\\_metro%' ESCAPE '\\' THEN 'Neighborhood context' ELSE 'Core DVF / spatial' END"""
HEAT = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
PREDICTIVE = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95)
ANCHORED = f"{PRED}, an AS (SELECT *, CASE WHEN sale_id % 4 <> 0 THEN pred_b END AS anchor_a, CASE WHEN sale_id % 3 <> 0 THEN surface * 1200 END AS anchor_b, CASE WHEN sale_id % 5 <> 0 THEN pred_b * 0.9::DOUBLE END AS anchor_c, CASE WHEN area % 2 = 0 THEN surface * 900 END AS anchor_d FROM pred WHERE sale_year = 1999)"
CORRECTION = f"""{ANCHORED}, long AS (SELECT price, pred_a, 'anchor_a' AS anchor, anchor_a AS v FROM an UNION ALL SELECT price, pred_a, 'anchor_b', anchor_b FROM an UNION ALL SELECT price, pred_a, 'anchor_c', anchor_c FROM an UNION ALL SELECT price, pred_a, 'anchor_d', anchor_d FROM an),
  corr AS (SELECT anchor, CAST(k AS INTEGER) AS weight, round(avg(abs(coalesce(pred_a * (k / 100::DOUBLE) + v * (1 - k / 100::DOUBLE), pred_a) - price)), 4) AS mae FROM long CROSS JOIN (SELECT unnest(range(101)) AS k) GROUP BY anchor, k)"""


def _split(numbers: list[str], categories: list[str], rows: str) -> str:
    """The best split of each node of `rows` (node, b_<feature>, g): node, feature, place, pos, left (array of bins), gain; l2 2, leaves of 20."""
    cells = " UNION ALL ".join(
        f"SELECT node, '{c}' AS feature, {i} AS place, CAST(b_{c} AS VARCHAR) AS bin, " + (f"CAST(b_{c} AS DOUBLE)" if c in numbers else "round(sum(g) / count(*), 9)") + f" AS by_, sum(g) AS s, count(*) AS n FROM {rows} GROUP BY node, b_{c}"
        for i, c in enumerate([*numbers, *categories])
    )
    return f"""SELECT * FROM (SELECT node, feature, place, pos, levels, round(ls * ls / (ln + 2) + (s - ls) * (s - ls) / (n - ln + 2) - s * s / (n + 2), 6) AS gain, ln, n FROM (
        SELECT node, feature, place, row_number() OVER w AS pos, list(bin) OVER w AS levels, sum(s) OVER w AS ls, sum(n) OVER w AS ln, sum(s) OVER p AS s, sum(n) OVER p AS n FROM ({cells})
        WINDOW w AS (PARTITION BY node, feature ORDER BY by_, bin ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY node, feature)) WHERE ln >= 20 AND n - ln >= 20)
      WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, place, pos) = 1"""


def _round(numbers: list[str], categories: list[str], huber: bool) -> str:
    """One boosting round of depth 2 over log price per m2, from scratch: bins at 16ths, two levels of splits, leaves."""
    bins = ", ".join(f"CAST(len(list_filter(e_{c}, lambda x: x < {c})) + 1 AS INTEGER) AS b_{c}" for c in numbers) + "".join(f", CAST({c} AS VARCHAR) AS b_{c}" for c in categories)
    edges = ", ".join(f"list_sort(list_distinct(quantile_disc(CAST({c} AS DOUBLE), [{', '.join(str(i / 16) for i in range(1, 16))}]))) AS e_{c}" for c in numbers)
    base = "median(goal)" if huber else "avg(goal)"
    grad = "greatest(least(r, bound), -bound)" if huber else "r"
    move = "CASE " + " ".join(f"WHEN s.feature = '{c}' THEN list_contains(s.levels, CAST(b_{c} AS VARCHAR))" for c in [*numbers, *categories]) + " END"
    step = lambda rows, split: f"SELECT {rows}.* REPLACE (CASE WHEN s.node IS NULL THEN {rows}.node WHEN {move} THEN 2 * {rows}.node + 1 ELSE 2 * {rows}.node + 2 END AS node) FROM {rows} LEFT JOIN {split} s ON s.node = {rows}.node"
    value = "(m + avg(sign(r - m) * least(abs(r - m), bound)))" if huber else "avg(r)"
    threshold = "CASE " + " ".join(f"WHEN feature = '{c}' THEN list_extract(e_{c}, CAST(levels[-1] AS INTEGER))" for c in numbers) + " END"
    names = "CASE WHEN feature IN (" + ", ".join(f"'{c}'" for c in categories) + ") THEN array_to_string(list_sort(levels), ',') END" if categories else "CAST(NULL AS VARCHAR)"
    return f"""WITH {SALE}, t AS (SELECT *, ln(1 + ppm2) AS goal FROM sale WHERE sale_year <= 1999 AND surface > 0 AND ppm2 IS NOT NULL), e AS (SELECT {base} AS base, {edges} FROM t),
      z AS (SELECT t.*, goal - base AS r, {bins} FROM t CROSS JOIN e), d AS (SELECT quantile_cont(abs(r), 0.9) AS bound FROM z), n0 AS (SELECT z.*, bound, {grad} AS g, 0 AS node FROM z CROSS JOIN d),
      s0 AS ({_split(numbers, categories, 'n0')}), n1 AS ({step('n0', 's0')}), s1 AS (SELECT * FROM ({_split(numbers, categories, 'n1')}) WHERE EXISTS (SELECT 1 FROM s0)), n2 AS ({step('n1', 's1')}),
      l AS (SELECT node, count(*) AS n, {value} * count(*) / (count(*) + 2) AS value FROM (SELECT *, median(r) OVER (PARTITION BY node) AS m FROM n2) GROUP BY node{', m' if huber else ''})
      SELECT CAST(node AS INTEGER) AS node, feature, round({threshold}, 4) AS threshold, {names} AS levels, round(gain, 4) AS gain, CAST(NULL AS BIGINT) AS n_rows, CAST(NULL AS DOUBLE) AS value FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1) CROSS JOIN e
      UNION ALL SELECT CAST(node AS INTEGER), NULL, NULL, NULL, NULL, n, round(value, 4) FROM l"""


def _ordered(key: str) -> str:
    w = f"OVER (PARTITION BY {key} ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 90 PRECEDING)"
    return f"count(y) {w} AS n_{key}, coalesce(sum(y) {w}, 0) AS s_{key}"


def oracle_sql() -> dict[str, str]:
    x, y = _l93(LON, LAT)
    cx, cy = _l93("2.3499::DOUBLE", "48.8530::DOUBLE")
    x1, y1 = _l93("2.3499::DOUBLE", "48.8530::DOUBLE")
    blend = " UNION ALL ".join(f"SELECT {a} AS w_pred_a, {b} AS w_pred_b, {c} AS w_pred_c" for a, b, c in simplex(3))
    one = SALE.replace("sale AS (", "sale0 AS (", 1) + ", sale AS (SELECT * FROM sale0), me AS (SELECT CAST(-1 AS BIGINT) AS sale_id, DATE '2000-06-30' AS sale_date, 5000::DOUBLE AS x, 5000::DOUBLE AS y, 100::DOUBLE AS surface, CAST(4 AS BIGINT) AS rooms)"
    cand_one = CAND.replace("FROM sale s JOIN sale h", "FROM me s JOIN sale h")
    wins = _windows()
    agg = wins[wins.index("agg AS (") : wins.index(" FROM sale LEFT JOIN agg")]
    agg, picked = agg.split(") SELECT ", 1)
    mad = "median(abs(p - m)) AS mad FROM (SELECT sale_id, p, median(p) OVER (PARTITION BY sale_id) AS m FROM cand WHERE d <= 500 AND age <= 365) GROUP BY sale_id"
    wsel = """sum(w * p) / sum(w) AS a1, sum(w) * sum(w) / sum(w * w) AS a2, nullif(count(*) FILTER (WHERE sim), 0) AS a3,
      sum(w * exp(-abs(ln(s / ts)) / 0.25) * p) FILTER (WHERE sim) / sum(w * exp(-abs(ln(s / ts)) / 0.25)) FILTER (WHERE sim) AS a4"""
    wout = "round(a1, 4) AS weighted_comp_ppm2, round(a2, 4) AS effective_comparable_count, a3 AS similar_comparable_count, round(a4, 4) AS similar_weighted_comp_ppm2"
    nearest = lambda where: f"(SELECT s.sale_id, round(min(sqrt((s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y))), 4) AS d FROM sale s LEFT JOIN poi p ON {where} GROUP BY 1)"
    return {
        "cohort_single_item": """SELECT l.l_orderkey, CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_extendedprice AS DOUBLE) AS price, round(CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE), 4) AS unit_price,
          CAST(month(l_shipdate) AS INTEGER) AS month, CAST(dayofyear(l_shipdate) AS INTEGER) AS day_of_year, CAST(year(l_shipdate) AS INTEGER) AS year, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INTEGER) AS months_since_1995
          FROM lineitem l JOIN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_returnflag = 'A') = 1 AND count(*) FILTER (WHERE l_returnflag = 'R') = 0) g ON g.l_orderkey = l.l_orderkey
          WHERE l_returnflag = 'A' AND l_quantity BETWEEN 5 AND 45 AND l_extendedprice IS NOT NULL""",
        "cohort_counts_by_year": f"WITH {SALE} SELECT sale_year, count(*) AS n_rows, count(DISTINCT area) AS n_areas, count(surface) AS n_surface, CAST(min(sale_date) AS VARCHAR) AS first_date, CAST(max(sale_date) AS VARCHAR) AS last_date FROM sale GROUP BY 1",
        "cohort_filters": """SELECT c_custkey, nation2, bal, least(greatest(bal, 100), 4000) AS clipped, CASE WHEN bal BETWEEN 1000 AND 2000 THEN bal END AS ranged
          FROM (SELECT c_custkey, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS nation2, CAST(c_acctbal AS DOUBLE) AS bal FROM customer) WHERE bal BETWEEN 0 AND 5000 AND regexp_full_match(nation2, '0[1-9]|1[0-9]')""",
        "year_split_counts": f"""WITH {SALE} SELECT part, count(*) AS n, round(sum(price), 2) AS total FROM sale JOIN (VALUES ('development', 0, 1998), ('validation', 1999, 1999), ('final_train', 0, 1999), ('test', 2000, 2000)) v(part, a, b)
          ON sale_year BETWEEN a AND b GROUP BY 1""",
        "comps_windows": wins,
        "comps_weighted": f"WITH {SALE}, {CAND}, {WEIGHTS}, agg AS (SELECT sale_id, {wsel} FROM w GROUP BY 1) SELECT sale_id, {wout.replace(', 4)', ', 6)')} FROM sale LEFT JOIN agg USING (sale_id)",
        "comps_mad": f"WITH {SALE}, {CAND}, agg AS (SELECT sale_id, {mad}) SELECT sale_id, round(mad, 4) AS local_365d_500m_mad_ppm2 FROM sale LEFT JOIN agg USING (sale_id)",
        "comps_quality": f"""WITH {SALE}, {CAND}, {WEIGHTS}, agg AS (SELECT sale_id, count(*) FILTER (WHERE d <= 500 AND age <= 365) AS c1, count(*) FILTER (WHERE d <= 1000 AND age <= 365) AS c2, sum(w * p) / sum(w) AS a1 FROM w GROUP BY 1)
          SELECT sale_year, count(*) AS n_rows, round(avg(CAST(a1 IS NOT NULL AS DOUBLE)), 6) AS coverage, round(median(coalesce(c1, 0)), 6) AS median_count_500m, round(median(coalesce(c2, 0)), 6) AS median_count_1000m,
          min(coalesce(c2, 0)) AS min_count_1000m, max(coalesce(c2, 0)) AS max_count_1000m FROM sale LEFT JOIN agg USING (sale_id) GROUP BY 1""",
        "asof_latest": f"WITH {ASOF} SELECT probe_id, building, diag_id, round(score, 4) AS score, age_days FROM j",
        "asof_leakage": f"""WITH {ASOF} SELECT count(*) AS n_rows, count(*) FILTER (WHERE diag_ts > probe_ts) AS n_future, count(diag_ts) AS n_available,
          round(avg(CASE WHEN diag_ts IS NULL THEN 0::DOUBLE WHEN abs(score - value) / nullif(value, 0) <= 0.15 THEN 1::DOUBLE ELSE 0.6::DOUBLE END), 6) AS mean_confidence, min(age_days) AS min_age, max(age_days) AS max_age FROM j""",
        "address_key": """WITH t AS (SELECT s_suppkey AS k, '75' || s_nationkey AS n, 'X' || s_suppkey AS road, CASE s_suppkey % 5 WHEN 0 THEN 'b' WHEN 1 THEN 't' WHEN 2 THEN 'q' WHEN 3 THEN 'a' ELSE '' END AS suf,
          CASE WHEN s_suppkey % 7 <> 0 THEN CAST(s_suppkey AS VARCHAR) END AS num FROM supplier)
          SELECT k AS s_suppkey, n || '_' || CASE WHEN length(right(road, 4)) < 4 THEN lpad(right(road, 4), 4, '0') ELSE right(road, 4) END || '_' || CASE WHEN length(num) < 5 THEN lpad(num, 5, '0') ELSE num END || CASE WHEN suf <> '' THEN '_' || suf ELSE '' END AS address_key,
          n || '_' || road AS street_id, n || '_' || road || '_' || coalesce(num, '-1') || '_' || suf AS address_id, CASE WHEN k % 3 = 0 THEN 'p' ELSE 'unknown' END AS parcel_id, num AS number_text FROM t""",
        "link_ranked": "SELECT l_orderkey AS addr, l_suppkey AS building, CAST(l_quantity AS DOUBLE) AS reliability FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC NULLS LAST, l_linenumber, l_suppkey) = 1",
        "link_fallback_conf": f"WITH {RESOLVED} SELECT sale_id, building_id, match_method, match_confidence, n_address, n_parcel FROM res",
        "link_audit_rates": f"WITH {RESOLVED} SELECT count(*) AS n_rows, round(avg(CAST(match_method <> 'unmatched' AS DOUBLE)), 6) AS match_rate, round(avg(CAST(match_confidence >= 0.8 AS DOUBLE)), 6) AS high_confidence_rate FROM res",
        "address_match": f"""WITH {SALE}, {POI}, a AS (SELECT poi_id % 150 AS akey, * FROM poi QUALIFY row_number() OVER (PARTITION BY poi_id % 150 ORDER BY poi_id) = 1)
          SELECT s.sale_id, a.poi_id AS ban_address_id, CASE WHEN a.poi_id IS NULL THEN 'unmatched' ELSE 'exact_key' END AS ban_match_method, round(sqrt((s.x - a.x) * (s.x - a.x) + (s.y - a.y) * (s.y - a.y)), 4) AS ban_match_distance_m,
          CAST(CASE WHEN a.poi_id IS NULL THEN 0 WHEN sqrt((s.x - a.x) * (s.x - a.x) + (s.y - a.y) * (s.y - a.y)) <= 100 THEN 1 ELSE 0.85 END AS DOUBLE) AS ban_match_confidence FROM sale s LEFT JOIN a ON a.akey = s.sale_id % 150""",
        "dedup_keep_last_nulls": """SELECT s_suppkey, s_nationkey, annee FROM (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 9 <> 0 THEN s_suppkey % 6 + 2015 END AS annee FROM supplier)
          QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY annee DESC NULLS FIRST, s_suppkey) = 1""",
        "star_stitch": """WITH a AS (SELECT * FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) = 1), b AS (SELECT * FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 1)
          SELECT n_nationkey AS key, n_name, s_suppkey AS supp, c_custkey AS cust, round(CAST(s_acctbal AS DOUBLE), 4) AS built, CASE WHEN c_custkey % 2 = 0 THEN round(CAST(c_acctbal AS DOUBLE), 4) END AS height,
          CASE WHEN 2000 - CAST(s_acctbal AS DOUBLE) BETWEEN 0 AND 1000 THEN round(2000 - CAST(s_acctbal AS DOUBLE), 4) END AS building_age_at_sale, CAST(s_acctbal IS NULL AS INTEGER) AS building_year_missing, 0 AS elevator_source_available
          FROM nation LEFT JOIN a ON s_nationkey = n_nationkey LEFT JOIN b ON c_nationkey = n_nationkey""",
        "nearest_poi": f"WITH {SALE}, {POI} SELECT sale_id, d AS distance_m FROM {nearest('true')}",
        "nearest_by_mode": f"WITH {SALE}, {POI} SELECT a.sale_id, a.d AS distance_mode0_m, b.d AS distance_mode1_m, c.d AS distance_mode2_m, e.d AS distance_mode3_m FROM {nearest('p.mode = 0')} a JOIN {nearest('p.mode = 1')} b USING (sale_id) JOIN {nearest('p.mode = 2')} c USING (sale_id) JOIN {nearest('p.mode = 3')} e USING (sale_id)",
        "radius_count": f"WITH {SALE}, {POI} SELECT s.sale_id, count(p.poi_id) AS n_points FROM sale s LEFT JOIN poi p ON (s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y) <= 250000 GROUP BY 1",
        "radius_weighted_sum": f"WITH {SALE}, {POI} SELECT s.sale_id, count(p.poi_id) AS n_points, round(coalesce(sum(p.weight), 0), 2) AS weight_sum FROM sale s LEFT JOIN poi p ON (s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y) <= 250000 GROUP BY 1",
        "polygon_max_level": f"WITH {SALE}, {POLY} SELECT sale_id, level, coalesce(level, 50) AS level_filled, CAST(level IS NULL AS INTEGER) AS level_missing, greatest(level, 60) AS level_max FROM levels",
        "lambert93": f"SELECT c_custkey, round({x}, 3) AS x_l93, round({y}, 3) AS y_l93 FROM customer",
        "polar_features": f"SELECT c_custkey, round(sqrt(({x} - {x1}) ** 2 + ({y} - {y1}) ** 2), 3) AS distance_center_m, round(sin(atan2({y} - {cy}, {x} - {cx})), 3) AS bearing_sin, round(cos(atan2({y} - {cy}, {x} - {cx})), 3) AS bearing_cos FROM customer",
        "grid_cells": f"WITH {SALE}, " + ", ".join(_hexagons(r, m) for r, m in ((8, 531.4), (9, 200.8), (10, 75.9))) + " SELECT * FROM c8 JOIN c9 USING (sale_id) JOIN c10 USING (sale_id)",
        "parse_geopoint": """SELECT s_suppkey, CASE WHEN s_suppkey % 11 <> 0 THEN -CAST((s_suppkey % 180) || '.5' AS DOUBLE) END AS lon, CASE WHEN s_suppkey % 11 <> 0 THEN CAST((s_suppkey % 90) || '.' || lpad(CAST(s_suppkey % 100 AS VARCHAR), 2, '0') AS DOUBLE) END AS lat FROM supplier""",
        "wkt_centroid": "SELECT s_suppkey, CASE WHEN s_suppkey % 13 <> 0 THEN round((3.0::DOUBLE * s_suppkey + 0.5::DOUBLE - 4) / 4, 6) END AS cx, CASE WHEN s_suppkey % 13 <> 0 THEN round((10::DOUBLE + s_suppkey) / 4, 6) END AS cy FROM supplier",
        "quoted_token_weight": "SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 4 = 2 THEN 2 ELSE 1 END AS BIGINT) AS weight, CAST(s_suppkey AS INTEGER) AS db FROM supplier",
        "text_labels": f"""WITH {NAMES}, every AS (SELECT unnest({list(all_features())}) AS name, unnest(range({len(all_features())})) AS i),
          named AS (SELECT * FROM names UNION ALL SELECT n_nationkey, (['ban_address_id', 'cell_r8', 'building_year', 'code_postal'])[n_nationkey % 4 + 1] FROM nation UNION ALL SELECT n_nationkey, e.name FROM nation JOIN every e ON e.i % 25 = n_nationkey)
          SELECT n_nationkey, name, CASE WHEN name IN ('ban_address_id', 'bdnb_building_id', 'bdnb_match_method', 'cell_r8', 'cell_r9') THEN 'Identity / micro-location'
            WHEN regexp_matches(name, '^(local|weighted|similar|effective|nearest)_|^median_comparable') THEN 'Historical comparables'
            WHEN regexp_matches(name, '^(dpe|classe|conso|emission)_|^type_(installation|energie)|^annee_construction_dpe|^nombre_niveau|^surface_habitable') THEN 'DPE / energy'
            WHEN regexp_matches(name, '^(building|bdnb|ban|usage|mat)_') THEN 'Building / linkage'
            WHEN regexp_matches(name, '^distance_(metro|rer|train|tram|school|green|shop)|^(rail|school|green|shop|noise)_') THEN 'Neighborhood context' ELSE 'Core DVF / spatial' END AS family,
          CASE name {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items())} ELSE upper(left(replace(name, '_', ' '), 1)) || lower(substr(replace(name, '_', ' '), 2)) END AS label FROM named""",
        "config_json": """SELECT n_nationkey, '{"alpha":' || CAST(n_nationkey / 4.0::DOUBLE AS VARCHAR) || ',"name":"' || n_name || '","top":' || n_regionkey || '}' AS config, n_nationkey / 4.0::DOUBLE AS alpha, n_name AS name FROM nation""",
        "scalar_ratios": f"""WITH {SALE} SELECT sale_id, round(rooms / greatest(surface, 1) * 10, 6) AS rooms_per_10m2, round(ln(1 + surface), 6) AS log_surface, round(ln(ppm2 / 5000), 6) AS residual, CAST((year(sale_date) - 1995) * 12 + month(sale_date) - 1 AS INTEGER) AS months,
          CAST(sale_date - DATE '1970-01-01' AS INTEGER) AS day, strftime(sale_date, '%Y-%m') AS year_month, round(abs(surface - rooms * 20) / (rooms * 20), 6) AS difference FROM sale""",
        "median_baseline": f"""WITH {SALE}, m AS (SELECT area, median(ppm2) AS m FROM sale WHERE sale_year <= 1999 GROUP BY 1), g AS (SELECT median(ppm2) AS g FROM sale WHERE sale_year <= 1999)
          SELECT sale_id, round(coalesce(m.m, g.g) * surface, 4) AS baseline FROM sale LEFT JOIN m USING (area) CROSS JOIN g WHERE sale_year = 2000""",
        "regression_metrics": f"WITH {PRED} SELECT 'a' AS model, {_metrics('pred_a')} FROM test UNION ALL SELECT 'b', {_metrics('pred_b')} FROM test",
        "metrics_by_segment": f"WITH {PRED} SELECT segment, {_metrics('pred_a')} FROM test GROUP BY segment",
        "monthly_stability": f"""WITH {PRED}, e AS (SELECT *, (pred_a - price) / price * 100 AS err, strftime(sale_date, '%Y-%m') AS year_month FROM test)
          SELECT year_month, round(avg(abs(err)), 4) AS mape, round(median(err), 4) AS median_error, round(median(price), 4) AS median_price, count(*) AS n FROM e GROUP BY 1""",
        "signed_gain": f"""WITH {PRED}, e AS (SELECT area, abs(pred_b - price) - abs(pred_a - price) AS gain FROM test)
          SELECT area, round(avg(gain), 4) AS mean_gain, round(avg(CAST(gain > 0 AS DOUBLE)), 4) AS share_better, round(avg(least(greatest(gain, -20000), 20000)), 4) AS clipped_gain FROM e GROUP BY 1""",
        "qcut_deciles": f"""WITH {PRED}, q AS (SELECT list_distinct(quantile_cont(price, [{", ".join(str(i / 10) for i in range(11))}])) AS e FROM test),
          b AS (SELECT test.*, CAST(greatest(len(list_filter(e, lambda v: v < price)) - 1, 0) AS INTEGER) AS decile FROM test CROSS JOIN q)
          SELECT decile, count(*) AS n, round(min(price), 4) AS low, round(max(price), 4) AS high, round(avg(abs(pred_a - price)), 4) AS mae FROM b GROUP BY 1""",
        "fixed_bands": f"""WITH {PRED} SELECT CASE WHEN surface >= 9 AND surface < 25 THEN '9-24' WHEN surface >= 25 AND surface < 40 THEN '25-39' WHEN surface >= 40 AND surface < 60 THEN '40-59' WHEN surface >= 60 AND surface < 80 THEN '60-79'
          WHEN surface >= 80 AND surface < 120 THEN '80-119' WHEN surface >= 120 AND surface < 301 THEN '120-300' END AS band, count(*) AS n, round(median(pred_a - price), 4) AS median_bias FROM pred GROUP BY 1""",
        "noise_band_shares": f"""WITH {SALE}, {POLY}, b AS (SELECT CASE WHEN level <= 54.999 THEN '<55' WHEN level <= 59.999 THEN '55-59' WHEN level <= 64.999 THEN '60-64' WHEN level <= 69.999 THEN '65-69' WHEN level IS NOT NULL THEN '70+' END AS band FROM levels)
          SELECT CAST(v.position AS INTEGER) AS position, v.level, count(b.band) AS n, round(count(b.band) / (SELECT count(band) FROM b), 6) AS share FROM (VALUES (0, '<55'), (1, '55-59'), (2, '60-64'), (3, '65-69'), (4, '70+')) v(position, level) LEFT JOIN b ON b.band = v.level GROUP BY 1, 2""",
        "ecdf": f"""WITH {PRED}, e AS (SELECT segment, round(abs((pred_a - price) / price * 100), 3) AS err FROM test)
          SELECT DISTINCT segment, err, round(cume_dist() OVER (PARTITION BY segment ORDER BY err), 6) AS ecdf FROM e""",
        "price_histogram": f"WITH {SALE} SELECT CAST(least(24, floor(price / 20000)) AS INTEGER) AS bin, count(*) AS n FROM sale WHERE price BETWEEN 0 AND 500000 GROUP BY 1",
        "hexbin": f"WITH {SALE}, {_hexagons(8, 531.4)} SELECT cell_r8 AS cell, count(*) AS n, round(median(price), 4) AS median FROM c8 JOIN sale USING (sale_id) GROUP BY 1",
        "segment_heatmap": f"WITH {SALE} SELECT area, " + ", ".join(f"CASE WHEN count(price) FILTER (WHERE segment = '{s}') >= 20 THEN round(median(price) FILTER (WHERE segment = '{s}'), 4) END AS {s}_median, count(price) FILTER (WHERE segment = '{s}') AS {s}_n" for s in HEAT) + " FROM sale GROUP BY 1",
        "coverage_wilson": f"""WITH {PRED}, g AS (SELECT segment, count(*) FILTER (WHERE abs(pred_a - price) <= 0.1::DOUBLE * price) AS hits, count(*) AS n FROM test GROUP BY 1), p AS (SELECT *, hits / n AS p, 1.96::DOUBLE AS z FROM g)
          SELECT segment, hits, n, round(p, 6) AS share, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0::DOUBLE * n * n))) / (1 + z * z / n), 6) AS low,
          round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0::DOUBLE * n * n))) / (1 + z * z / n), 6) AS high FROM p""",
        "interval_calibration": f"WITH {PRED}, ev AS (SELECT price / pred_b AS ratio FROM test), b AS (" + " UNION ALL ".join(f"SELECT {v}::DOUBLE AS nominal, quantile_cont(ratio, {(1 - v) / 2}) AS low, quantile_cont(ratio, {(1 + v) / 2}) AS high FROM cal" for v in (0.5, 0.8, 0.9, 0.95)) + """)
          SELECT round(nominal, 6) AS nominal, round(low, 6) AS low, round(high, 6) AS high, round(avg(CAST(round(ratio, 9) BETWEEN round(low, 9) AND round(high, 9) AS DOUBLE)), 6) AS empirical FROM ev CROSS JOIN b GROUP BY nominal, low, high""",
        "empirical_interval": f"""WITH {PRED}, q AS (SELECT quantile_cont(ratio, 0.05) AS l, quantile_cont(ratio, 0.95) AS h FROM cal)
          SELECT sale_id, round(pred_b * l, 4) AS lower, round(pred_b * h, 4) AS upper, CAST(price BETWEEN pred_b * l AND pred_b * h AS INTEGER) AS covered FROM test CROSS JOIN q""",
        "calibration_pool": f"""WITH {PRED}, c AS (SELECT t.sale_id, count(*) FILTER (WHERE c.area = t.area AND c.pred_b BETWEEN t.pred_a * 0.5::DOUBLE AND t.pred_a * 2) AS a1, count(*) FILTER (WHERE c.area = t.area) AS a2, count(*) FILTER (WHERE c.pred_b BETWEEN t.pred_a * 0.5::DOUBLE AND t.pred_a * 2) AS a3, count(*) AS a4
          FROM test t CROSS JOIN cal c GROUP BY 1) SELECT sale_id, CASE WHEN a1 >= 120 THEN 0 WHEN a2 >= 120 THEN 1 WHEN a3 >= 250 THEN 2 ELSE 3 END AS tier, CASE WHEN a1 >= 120 THEN a1 WHEN a2 >= 120 THEN a2 WHEN a3 >= 250 THEN a3 ELSE a4 END AS n FROM c""",
        "predictive_quantiles": f"""WITH {PRED}, c AS (SELECT t.sale_id, count(*) FILTER (WHERE c.area = t.area AND c.pred_b BETWEEN t.pred_a * 0.5::DOUBLE AND t.pred_a * 2) AS a1, count(*) FILTER (WHERE c.area = t.area) AS a2, count(*) FILTER (WHERE c.pred_b BETWEEN t.pred_a * 0.5::DOUBLE AND t.pred_a * 2) AS a3
          FROM test t CROSS JOIN cal c GROUP BY 1), k AS (SELECT sale_id, CAST(CASE WHEN a1 >= 120 THEN 0 WHEN a2 >= 120 THEN 1 WHEN a3 >= 250 THEN 2 ELSE 3 END AS INTEGER) AS tier FROM c),
          m AS (SELECT t.sale_id, k.tier, t.pred_a, t.price * 1.037::DOUBLE AS ask, r.ratio FROM test t JOIN k USING (sale_id) JOIN cal r ON CASE k.tier WHEN 0 THEN r.area = t.area AND r.pred_b BETWEEN t.pred_a * 0.5::DOUBLE AND t.pred_a * 2
            WHEN 1 THEN r.area = t.area WHEN 2 THEN r.pred_b BETWEEN t.pred_a * 0.5::DOUBLE AND t.pred_a * 2 ELSE true END),
          a AS (SELECT sale_id, tier, any_value(pred_a) AS e, count(ratio) AS n, {", ".join(f"quantile_cont(ratio, {p}) AS q{round(p * 100):02d}" for p in PREDICTIVE)}, avg(CAST(round(abs(ratio - 1), 9) <= 0.1::DOUBLE AS DOUBLE)) AS p10, avg(CAST(round(abs(ratio - 1), 9) <= 0.2::DOUBLE AS DOUBLE)) AS p20,
            avg(CAST(ratio >= ask / pred_a AS DOUBLE)) AS pa FROM m GROUP BY 1, 2)
          SELECT sale_id, tier, n AS n_ratios, {", ".join(f"CASE WHEN n >= 100 THEN round(e * q{round(p * 100):02d}, 4) END AS value_q{round(p * 100):02d}" for p in PREDICTIVE)}, CASE WHEN n >= 100 THEN round(p10, 4) END AS p_within_10, CASE WHEN n >= 100 THEN round(p20, 4) END AS p_within_20, CASE WHEN n >= 100 THEN round(pa, 4) END AS p_at_least_ask FROM a""",
        "exact_quantiles": f"WITH {SALE} SELECT " + ", ".join(f"round(quantile_cont(price, {p}), 4) AS q{i}" for i, p in enumerate((0.02, 0.25, 0.5, 0.75, 0.98))) + " FROM sale",
        "blend_search": f"""WITH {PRED}, v AS (SELECT price, pred_a, pred_b, (pred_a + pred_b) / 2 + 100 AS pred_c FROM pred WHERE sale_year = 1999), g AS ({blend})
          SELECT w_pred_a, w_pred_b, w_pred_c, round(avg(abs(pred_a * (w_pred_a / 10::DOUBLE) + pred_b * (w_pred_b / 10::DOUBLE) + pred_c * (w_pred_c / 10::DOUBLE) - price)), 4) AS mae FROM v CROSS JOIN g GROUP BY 1, 2, 3""",
        "correction_search": f"WITH {CORRECTION} SELECT anchor, weight, mae FROM corr",
        "best_correction": f"WITH {CORRECTION} SELECT anchor, weight, mae FROM corr QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY mae, weight) = 1",
        "bootstrap_mae": f"WITH {_reps(500)} " + " UNION ALL ".join(f"SELECT '{m}' AS model, round(quantile_cont({m}, 0.025), 4) AS mae_low, round(quantile_cont({m}, 0.975), 4) AS mae_high, round(quantile_cont(b - {m}, 0.025), 4) AS gain_low, round(quantile_cont(b - {m}, 0.975), 4) AS gain_high FROM reps" for m in "ab"),
        "paired_bootstrap": f"WITH {_reps(1000)} " + " UNION ALL ".join(f"SELECT '{p}' AS model_a, '{q}' AS model_b, round(avg({p} - {q}), 4) AS mean_diff, round(quantile_cont({p} - {q}, 0.025), 4) AS low, round(quantile_cont({p} - {q}, 0.975), 4) AS high, quantile_cont({p} - {q}, 0.025) > 0 OR quantile_cont({p} - {q}, 0.975) < 0 AS significant FROM reps" for p, q in ("ab", "ba")),
        "model_matrix": f"WITH {_reps(1000)} SELECT 'a' AS model_a, CAST(NULL AS DOUBLE) AS a, round(avg(a - b), 4) AS b FROM reps UNION ALL SELECT 'b', round(avg(b - a), 4), NULL FROM reps",
        "topk_by_family": "SELECT s_nationkey, s_suppkey, CAST(s_acctbal AS DOUBLE) AS gain, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier QUALIFY rank <= 3",
        "family_sums": f"WITH {NAMES} SELECT {FAMILY} AS family, round(sum(CAST(c_acctbal AS DOUBLE)), 2) AS total FROM names JOIN customer ON c_nationkey = n_nationkey GROUP BY 1",
        "rank_models": f"WITH {PRED}, m AS (SELECT segment, {_metrics('pred_a')} FROM test GROUP BY segment) SELECT segment, mae, row_number() OVER (ORDER BY mae, segment) AS rank FROM m",
        "hashed_sample": f"WITH {SALE} SELECT sale_id, price FROM sale ORDER BY md5(sale_id || '|42'), sale_id LIMIT 500",
        "missing_rates": f"WITH {SALE} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg(CAST({c} IS NULL AS DOUBLE)), 6) AS rate FROM sale" for c in ("sale_id", "sale_date", "sale_year", "segment", "area", "price", "surface", "rooms", "ppm2", "x", "y")),
        "union_missing_cols": "SELECT 'poi' AS family, count(*) AS n, count(s_suppkey % 4) AS n_mode, CAST(0 AS BIGINT) AS n_level, count(DISTINCT s_suppkey) AS n_poi FROM supplier UNION ALL SELECT 'poly', count(*), 0, count(*), 0 FROM nation",
        "prediction_export": f"WITH {PRED} SELECT sale_id, price, round(pred_a, 2) AS prediction_a, round(pred_b, 2) AS prediction_b, round(abs(pred_a - price), 2) AS absolute_error, round((pred_a - price) / price * 100, 4) AS percent_error FROM test",
        "ridge_search": f"""WITH {SALE}, f AS (SELECT sale_id, sale_year, price, surface, ln(1 + price / surface) AS y FROM sale WHERE surface > 0),
          st AS (SELECT part, avg(surface) AS m, stddev_samp(surface) AS s, count(*) AS n, avg(y) AS yb, covar_pop(surface, y) * count(*) / stddev_samp(surface) AS szy FROM f JOIN (VALUES ('dev', 1998), ('final', 1999)) p(part, upto) ON sale_year <= upto GROUP BY 1),
          b AS (SELECT part, m, s, yb, alpha, szy / (n - 1 + alpha) AS b FROM st CROSS JOIN (VALUES (0.1::DOUBLE), (1.0::DOUBLE), (10.0::DOUBLE), (100.0::DOUBLE)) a(alpha)),
          v AS (SELECT alpha, avg(abs(greatest(exp(yb + b * (surface - m) / s) - 1, 0) * surface - price)) AS mae FROM f JOIN b ON b.part = 'dev' WHERE sale_year = 1999 GROUP BY 1 ORDER BY mae, alpha LIMIT 1)
          SELECT sale_id, round(price, 1) AS price, round(round_even(greatest(exp(yb + b * (surface - m) / s) - 1, 0) * surface, 2), 1) AS prediction_ridge_one FROM f JOIN b ON b.part = 'final' JOIN v USING (alpha) WHERE sale_year = 2000""",
        "gbt_huber_round": _round(["surface", "rooms"], [], True),
        "gbt_categorical_round": _round(["rooms"], ["segment", "area"], False),
        "perm_importance_linear": f"""WITH {SALE}, f AS (SELECT sale_id, sale_year, price, surface, ln(1 + price / surface) AS goal FROM sale WHERE surface > 0),
          st AS (SELECT avg(surface) AS m, stddev_samp(surface) AS s, avg(goal) AS yb, covar_pop(surface, goal) * count(*) / stddev_samp(surface) / (count(*) - 1 + 1.0::DOUBLE) AS b FROM f WHERE sale_year <= 1999),
          t AS (SELECT * FROM f WHERE sale_year = 2000 ORDER BY md5(sale_id || '|42'), sale_id LIMIT 5000), k AS (SELECT unnest([0, 1, 2]) AS r),
          l AS (SELECT r, sale_id, price, surface, row_number() OVER (PARTITION BY r ORDER BY md5(sale_id || '|a' || r), sale_id) AS n FROM t CROSS JOIN k),
          g AS (SELECT r, surface AS given, row_number() OVER (PARTITION BY r ORDER BY md5(sale_id || '|b' || r), sale_id) AS n FROM t CROSS JOIN k),
          p AS (SELECT r, avg(abs(greatest(exp(yb + b * (given - m) / s) - 1, 0) * given - price)) - avg(abs(greatest(exp(yb + b * (surface - m) / s) - 1, 0) * surface - price)) AS rise FROM l JOIN g USING (r, n) CROSS JOIN st GROUP BY r)
          SELECT 'surface' AS feature, round(avg(rise), 1) AS importance FROM p""",
        "ordered_target_stats": f"""WITH {SALE}, t AS (SELECT sale_id, area, segment, CAST(x AS BIGINT) || '_' || CAST(y AS BIGINT) AS place, ln(1 + ppm2) AS y, CAST(sale_date - DATE '1970-01-01' AS BIGINT) AS day, 0 AS one FROM sale),
          w AS (SELECT sale_id, {", ".join(_ordered(k) for k in ("area", "segment", "place", "one"))} FROM t)
          SELECT sale_id, {", ".join(f"n_{k} AS {k}__n, round((s_{k} + 10 * (s_one / nullif(n_one, 0))) / (n_{k} + 10), 6) AS {k}__mean" for k in ("area", "segment", "place"))} FROM w""",
        "duplicate_ids": "SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1",
        "row_changes": f"""WITH {SALE}, b AS (SELECT sale_id, count(*) AS n FROM sale GROUP BY 1), a AS (SELECT sale_id, count(*) AS n FROM (SELECT sale_id FROM sale WHERE sale_id % 7 <> 0 UNION ALL SELECT sale_id FROM sale WHERE sale_id % 11 = 0 UNION ALL SELECT -sale_id FROM sale WHERE sale_id % 13 = 0) GROUP BY 1)
          SELECT coalesce(a.sale_id, b.sale_id) AS sale_id, coalesce(a.n, 0) - coalesce(b.n, 0) AS change FROM a FULL JOIN b ON a.sale_id = b.sale_id WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""",
        "out_of_order": f"""WITH {SALE}, s AS (SELECT sale_id, CAST(sale_date - CAST(sale_id % 5 * 300 AS INTEGER) AS DATE) AS d FROM sale), o AS (SELECT *, ((d - DATE '1970-01-01') * 10 + sale_id % 100 * 500) * 1000000 + sale_id AS place FROM s)
          SELECT sale_id, CAST(d AS VARCHAR) AS "on" FROM (SELECT *, max(d) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o) WHERE d < before""",
        "one_to_one_join": f"WITH {PRED} SELECT s.sale_id, s.area, round(s.surface, 4) AS surface, round(p.pred_a, 4) AS pred_a FROM sale s JOIN pred p ON p.sale_id = s.sale_id WHERE s.sale_year = 2000 AND p.segment = 'BUILDING'",
        "one_to_one_left": "SELECT n_nationkey AS key, n_name, c.c_custkey FROM nation LEFT JOIN (SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer WHERE c_nationkey % 3 <> 0 GROUP BY 1) c ON c.c_nationkey = n_nationkey",
        "relation_distinct": "SELECT l_linenumber AS record, count(*) AS n, round(sum(CAST(s_acctbal AS DOUBLE)), 2) AS total FROM (SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 0 GROUP BY 1",
        "utc_instants": """SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + to_seconds(o_orderkey % 24 * 3600 + 930) - to_seconds(CASE o_orderkey % 5 WHEN 1 THEN 7200 WHEN 2 THEN -19800 ELSE 0 END), '%Y-%m-%d %H:%M:%S') AS utc FROM orders WHERE o_orderkey % 5 <> 4
          UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 5 = 4""",
        "template_rows": f"""WITH {SALE}, t AS (SELECT *, CAST(sale_date + CAST(sale_id % 400 - 200 AS INTEGER) AS DATE) AS rd FROM sale WHERE sale_date <= DATE '1997-06-30' QUALIFY row_number() OVER (PARTITION BY area ORDER BY sale_date DESC, sale_id) = 1)
          SELECT area, sale_id, round(price, 4) AS price, CASE WHEN rd <= DATE '1997-06-30' THEN round(surface, 4) END AS surface, CASE WHEN rd <= DATE '1997-06-30' THEN rooms END AS rooms, CASE WHEN rd <= DATE '1997-06-30' THEN CAST(DATE '1997-06-30' - rd AS INTEGER) END AS record_age_days FROM t""",
        "imputed_features": f"""WITH {SALE}, s AS (SELECT sale_id, sale_year, surface, CASE WHEN sale_id % 6 <> 0 THEN CAST(rooms AS DOUBLE) END AS rooms, CASE WHEN sale_id % 8 <> 0 THEN segment END AS segment FROM sale), m AS (SELECT median(surface) AS s, median(rooms) AS r FROM s WHERE sale_year <= 1999)
          SELECT sale_id, round(coalesce(surface, m.s), 4) AS surface_in, CAST(surface IS NULL AS DOUBLE) AS surface_missing, round(coalesce(rooms, m.r), 4) AS rooms_in, CAST(rooms IS NULL AS DOUBLE) AS rooms_missing, coalesce(segment, '__MISSING__') AS segment_cat FROM s CROSS JOIN m WHERE sale_year = 2000""",
        "imputed_modes": f"""WITH {SALE}, s AS (SELECT sale_id, sale_year, CASE WHEN sale_id % 8 <> 0 THEN segment END AS segment, CASE WHEN sale_id % 6 <> 0 THEN CAST(area AS VARCHAR) END AS area FROM sale),
          a AS (SELECT segment AS m FROM s WHERE sale_year <= 1999 AND segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), b AS (SELECT area AS m FROM s WHERE sale_year <= 1999 AND area IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
          SELECT sale_id, coalesce(segment, (SELECT m FROM a)) AS segment_cat, coalesce(area, (SELECT m FROM b)) AS area_cat FROM s WHERE sale_year = 2000""",
        "target_forms": f"""WITH {SALE}, t AS (SELECT *, CASE WHEN sale_id % 9 <> 0 THEN area * 100 + 500 END AS anchor FROM sale)
          SELECT sale_id, round(ln(1 + price), 4) AS y_total, round(price, 4) AS price_total, round(ln(1 + ppm2), 4) AS y_ppm2, CASE WHEN ppm2 IS NOT NULL THEN round(price, 4) END AS price_ppm2, round(ln(ppm2 / anchor), 4) AS y_residual, CASE WHEN anchor IS NOT NULL AND ppm2 IS NOT NULL THEN round(price, 4) END AS price_residual FROM t""",
        "dealt_values": f"""WITH {SALE}, s AS (SELECT sale_id, surface FROM sale WHERE sale_year = 2000 ORDER BY md5(sale_id || '|42'), sale_id LIMIT 1000), l AS (SELECT sale_id, row_number() OVER (ORDER BY md5(sale_id || '|a1'), sale_id) AS n FROM s), r AS (SELECT surface, row_number() OVER (ORDER BY md5(sale_id || '|b1'), sale_id) AS n FROM s)
          SELECT sale_id, round(surface, 4) AS surface FROM l JOIN r USING (n)""",
        "enriched_counts": f"""WITH {SALE}, {POI}, a AS (SELECT * FROM poi QUALIFY row_number() OVER (PARTITION BY mode, poi_id % 3 ORDER BY CASE WHEN poi_id % 4 <> 0 THEN poi_id % 6 END DESC NULLS FIRST, poi_id) = 1), b AS (SELECT * FROM poi QUALIFY row_number() OVER (PARTITION BY mode ORDER BY poi_id) = 1),
          n AS (SELECT s.sale_id, (SELECT count(*) FROM a WHERE (a.x - s.x) ** 2 + (a.y - s.y) ** 2 <= 1000000) AS last_count, (SELECT count(*) FROM b WHERE (b.x - s.x) ** 2 + (b.y - s.y) ** 2 <= 1000000) AS first_count, (SELECT count(*) FROM poi p WHERE (p.x - s.x) ** 2 + (p.y - s.y) ** 2 <= 1000000) AS c FROM sale s)
          SELECT sale_id, last_count, first_count, CAST(2 * c AS DOUBLE) AS weighted_count FROM n""",
        "value_one": f"WITH {one}, {cand_one}, {agg}), m AS (SELECT sale_id, {mad}) SELECT {picked.replace('sale_id,', 'me.sale_id,', 1)}, {wout}, round(mad, 4) AS local_365d_500m_mad_ppm2 FROM me LEFT JOIN agg ON agg.sale_id = me.sale_id LEFT JOIN m ON m.sale_id = me.sale_id LEFT JOIN (SELECT sale_id, {wsel} FROM (SELECT * FROM ({WEIGHTS[6:-1]})) GROUP BY 1) ww ON ww.sale_id = me.sale_id",
    }
