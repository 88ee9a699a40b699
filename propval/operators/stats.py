"""Evaluation analytics: metrics, quantiles, bins, calibration, blends, paired bootstrap."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from propval.functions.geo import cell
from propval.functions.scalar import wilson
from propval.operators import bands
from propval.operators.selection import selected
from propval.session import written


def metric_columns(actual: str, predicted: str) -> list[Column]:
    """MAE, RMSE, R2, MAPE, MdAPE and shares within 10 and 20 %, rounded half to even."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    err, pct = F.abs(p - a), F.abs(F.try_divide(p - a, a)) * 100.0
    sst = F.sum(a * a) - F.sum(a) * F.sum(a) / F.count(a)
    return [
        F.bround(F.avg(err), 2).alias("mae"),
        F.bround(F.sqrt(F.avg(err * err)), 2).alias("rmse"),
        F.bround(1.0 - F.try_divide(F.sum(err * err), sst), 4).alias("r2"),
        F.bround(F.avg(pct), 2).alias("mape"),
        F.bround(F.median(pct), 2).alias("mdape"),
        F.bround(F.avg((pct <= 10).cast("double")), 4).alias("within_10"),
        F.bround(F.avg((pct <= 20).cast("double")), 4).alias("within_20"),
    ]


def metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *metric_columns(actual, predicted))


def quantiles(df: DataFrame, column: str, probs: Sequence[float]) -> DataFrame:
    """One row: exact quantiles with linear interpolation, q0, q1, ..."""
    return quantile_row(df, column, probs).select(*[F.col("q")[i].alias(f"q{i}") for i in range(len(probs))])


def quantile_row(df: DataFrame, column: str, probs: Sequence[float]) -> DataFrame:
    """One row, even of an empty table: q, the array of exact quantiles."""
    return selected(df, [], column, probs).agg(F.first("q").alias("q"))


def quantile_bins(df: DataFrame, column: str, bins: int, name: str = "bin") -> DataFrame:
    """Right-closed quantile bins from 0; equal edges are merged; null stays null. The edges are one row."""
    edges = quantile_row(df, column, [i / bins for i in range(bins + 1)]).select(F.array_distinct("q").alias("__edges"))
    below = F.size(F.filter("__edges", lambda e: e < F.col(column)))
    return df.crossJoin(F.broadcast(edges)).withColumn(name, F.when(F.col(column).isNotNull(), F.greatest(below - 1, F.lit(0)))).drop("__edges")


def level_shares(df: DataFrame, level: str, levels: Sequence[str]) -> DataFrame:
    """Count and share of each of a fixed list of levels, absent ones included; nulls count to no total."""
    known = df.where(F.col(level).isNotNull())
    table = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(levels)], "position int, level string")
    n = known.groupBy(F.col(level).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    total = known.agg(F.count(F.lit(1)).alias("total"))
    return table.join(n, "level", "left").crossJoin(F.broadcast(total)).select("position", "level", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.try_divide(F.coalesce("n", F.lit(0)).cast("double"), F.col("total")), F.lit(0.0)).alias("share"))


def ecdf(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """Distinct values with the share of rows at or below, within groups."""
    n = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    part = W.partitionBy(*by)
    run = F.sum("n").over(part.orderBy(column).rowsBetween(W.unboundedPreceding, 0))
    return n.select(*by, column, (run / F.sum("n").over(part)).alias("ecdf"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    inside = df.where(F.col(column).between(low, high))
    b = F.least(F.lit(bins - 1), F.floor((F.col(column) - low) / F.lit((high - low) / bins))).cast("int")
    return inside.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def hexbin(df: DataFrame, x: str, y: str, resolution: int, value: str) -> DataFrame:
    """cell, n, and the median of value, of each hexagon that holds rows."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(cell(F.col(x), F.col(y), resolution).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.median(value).alias("median"))


def heatmap(df: DataFrame, row: str, column: str, columns: Sequence[str], value: str, minimum: int = 20) -> DataFrame:
    """Pivoted medians, blank where a cell has fewer than `minimum` rows, and cell sizes."""
    wide = df.groupBy(row).pivot(column, list(columns)).agg(F.median(value).alias("median"), F.count(value).alias("n"))
    out = [F.col(row)]
    for c in columns:
        n = F.coalesce(F.col(f"`{c}_n`"), F.lit(0))
        out += [F.when(n >= minimum, F.col(f"`{c}_median`")).alias(f"{c}_median"), n.alias(f"{c}_n")]
    return wide.select(*out)


def coverage(df: DataFrame, hit: Column, by: Sequence[str]) -> DataFrame:
    """Hits, rows, share and Wilson's interval of each group."""
    g = df.groupBy(*by).agg(F.count_if(hit).alias("hits"), F.count(F.lit(1)).alias("n"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return g.withColumns({"share": F.try_divide(F.col("hits").cast("double"), F.col("n")), "low": low, "high": high})


def interval_coverage(calibration: DataFrame, evaluation: DataFrame, ratio: str, levels: Sequence[float] = (0.5, 0.8, 0.9, 0.95)) -> DataFrame:
    """For each nominal level: the calibration ratios' central bounds, and the share of evaluation ratios within."""
    probs = [x for v in levels for x in ((1 - v) / 2, (1 + v) / 2)]
    q = quantile_row(calibration, ratio, probs)
    bounds = q.select(F.explode(F.array(*[F.struct(F.lit(v).alias("nominal"), F.col("q")[2 * i].alias("low"), F.col("q")[2 * i + 1].alias("high")) for i, v in enumerate(levels)])).alias("b")).select("b.*")
    met = evaluation.where(F.col(ratio).isNotNull()).crossJoin(F.broadcast(bounds))
    to = lambda c: F.round(F.col(c), 9)  # noqa: E731  a ratio that equals a bound counts, whatever its last bit
    return met.groupBy("nominal", "low", "high").agg(F.avg(to(ratio).between(to("low"), to("high")).cast("double")).alias("empirical"))


def empirical_interval(calibration: DataFrame, test: DataFrame, ratio: str, predicted: str, actual: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """test with interval bounds predicted * quantile of the calibration ratios, and whether it held."""
    q = quantile_row(calibration, ratio, [low, high]).select(F.col("q")[0].alias("__l"), F.col("q")[1].alias("__h"))
    out = test.crossJoin(F.broadcast(q)).withColumns({"lower": F.col(predicted) * F.col("__l"), "upper": F.col(predicted) * F.col("__h")})
    return out.withColumn("covered", F.col(actual).between(F.col("lower"), F.col("upper"))).drop("__l", "__h")


#: Tiers of the calibration pool: the first that has enough rows is used.
POOL_TIERS = (("area and band", 120), ("area", 120), ("band", 250))


def counts_below(values: DataFrame, asked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """asked (its columns, v, inclusive) with below: how many values (by, v) of its group are < v, or <= v if inclusive.

    Values and bounds are positive. They run through one window a group and slot of values (a thousandth of a power of e); slot
    totals are summed before them. So no value meets a bound as a pair, and no task holds a group."""
    slot = F.floor(F.ln(F.greatest(F.col("v"), F.lit(1e-9))) * 1024)
    extra = [c for c in asked.columns if c not in (*by, "v", "inclusive")]
    marks = values.where("v IS NOT NULL").select(*by, "v", F.lit(1).alias("__kind"), F.lit(1).alias("__one"))
    bounds = asked.where("v IS NOT NULL").select(*by, "v", F.when(F.col("inclusive"), 2).otherwise(0).alias("__kind"), F.lit(0).alias("__one"), "inclusive", *extra)
    events = bounds.unionByName(marks, allowMissingColumns=True).withColumn("__slot", slot)
    inner = W.partitionBy(*by, "__slot").orderBy("v", "__kind").rowsBetween(W.unboundedPreceding, 0)
    total = events.groupBy(*by, "__slot").agg(F.sum("__one").alias("__in"))
    before = total.select(*by, "__slot", F.coalesce(F.sum("__in").over(W.partitionBy(*by).orderBy("__slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    ranked = events.withColumn("__upto", F.sum("__one").over(inner)).where("__one = 0").join(before, [*by, "__slot"])
    return ranked.select(*by, *extra, "v", "inclusive", (F.col("__upto") + F.col("__before")).alias("below"))


def calibration_pool(calibration: DataFrame, subjects: DataFrame, key: str, area: str, predicted: str, estimate: str) -> DataFrame:
    """key, tier (0..3), n: which calibration pool each subject gets, by rows of the same area and of a predicted value within
    0.5 to 2 times the estimate."""
    asks = subjects.select(key, area, F.explode(F.array(F.struct((F.col(estimate) * 0.5).alias("v"), F.lit(False).alias("inclusive")), F.struct((F.col(estimate) * 2.0).alias("v"), F.lit(True).alias("inclusive")))).alias("b")).select(key, area, "b.*")
    values = calibration.select(area, F.col(predicted).alias("v"))
    span = lambda name: F.sum(F.when(F.col("inclusive"), F.col("below")).otherwise(-F.col("below"))).alias(name)
    both = counts_below(values, asks, [area]).groupBy(key).agg(span("both"))
    band = counts_below(values.select("v"), asks.select(key, "v", "inclusive")).groupBy(key).agg(span("in_band"))
    in_area = calibration.groupBy(area).agg(F.count(predicted).alias("in_area"))
    total = calibration.agg(F.count(F.lit(1)).alias("all"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    counts = subjects.select(key, area).join(in_area, area, "left").join(both, key, "left").join(band, key, "left").select(key, zero("both"), zero("in_area"), zero("in_band")).crossJoin(F.broadcast(total))
    tier = F.when(F.col("both") >= POOL_TIERS[0][1], 0).when(F.col("in_area") >= POOL_TIERS[1][1], 1).when(F.col("in_band") >= POOL_TIERS[2][1], 2).otherwise(3)
    n = F.when(tier == 0, F.col("both")).when(tier == 1, F.col("in_area")).when(tier == 2, F.col("in_band")).otherwise(F.col("all"))
    return counts.select(key, tier.alias("tier"), n.cast("long").alias("n"))


#: Quantiles of the predictive distribution, and the fewest ratios that it may rest on.
PREDICTIVE, LEAST_RATIOS = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95), 100


#: Pairs of a subject and a row of its group up to which they are joined. Beyond, ranks do; both give the same.
MOST_PAIRS = 50_000_000


def own_bands(valid: DataFrame, tiers: DataFrame, key: str, area: str, estimate: str, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """key, n_ratios, __q, the shares of `predictive`, of the subjects whose pool is a price band of their own (tiers 0 and 2).

    valid: __area, p, v. The pairs that a join on the group would meet are counted first. If they are more than most_pairs, the bands' quantiles and counts
    come from bands.band_statistics, without pairs; else from the join, which is faster where it is small."""
    group = lambda a: F.concat(F.lit("area "), F.col(a).cast("string"))
    asks = tiers.where("tier IN (0, 2)").select(F.col(key).alias("key"), F.when(F.col("tier") == 0, group(area)).otherwise("all").alias("g"), (F.col(estimate) * 0.5).alias("low"), (F.col(estimate) * 2.0).alias("high"), "__ask")
    rows = valid.where("p IS NOT NULL").select(F.explode(F.array(group("__area"), F.lit("all"))).alias("g"), "p", "v").join(asks.select("g").distinct(), "g", "left_semi")
    each = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    pairs = asks.groupBy("g").agg(F.count(F.lit(1)).alias("m")).join(each, "g").agg(F.sum(F.col("m") * F.col("n"))).first()[0]
    if (pairs or 0) <= most_pairs:
        near = F.round(F.abs(F.col("v") - 1.0), 9)
        # the subjects are few bytes and much work: many tasks, however small the table
        spread = asks.repartition(int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
        met = spread.join(written(rows, "band-rows"), "g").where(F.col("p").between(F.col("low"), F.col("high")))
        shape = [F.percentile("v", F.array(*[F.lit(p) for p in PREDICTIVE])).alias("__q"), *[F.avg((near <= s).cast("double")).alias(f"p_within_{round(100 * s)}") for s in (0.1, 0.2)]]
        return met.groupBy(F.col("key").alias(key)).agg(*shape, F.count("v").alias("n_ratios"), F.avg((F.col("v") >= F.col("__ask")).cast("double")).alias("p_at_least_ask"))
    # the values that begin and end the ratios within 10 and 20 %, as `off` sees them: one row
    off = F.round(F.abs(F.col("v") - 1.0), 9)
    ends = [e for share in (0.1, 0.2) for e in (F.min(F.when(off <= share, F.col("v"))), F.min(F.when((off > share) & (F.col("v") > 1.0), F.col("v"))))]
    bounds = valid.agg(*[F.coalesce(e, F.lit(math.inf)).alias(f"__b{i}") for i, e in enumerate(ends)])
    seek = lambda i, share=None, bound=None: F.struct(F.lit(i).alias("i"), F.lit(share).cast("double").alias("share"), (F.lit(None).cast("double") if bound is None else F.col(bound)).alias("bound"))
    k = len(PREDICTIVE)
    seeks = F.array(*[seek(i, p) for i, p in enumerate(PREDICTIVE)], *[seek(k + i, bound=f"__b{i}") for i in range(4)], seek(k + 4, bound="__ask"))
    told = bands.band_statistics(rows, asks.crossJoin(F.broadcast(bounds)).select("key", "g", "low", "high", seeks.alias("seeks")))
    at = lambda i, field: F.get(F.filter("found", lambda x: x["i"] == i), F.lit(0))[field]

    def quantile(i: int, p: float) -> Column:
        place = F.lit(float(p)) * (F.col("n") - 1)
        share = place - F.floor(place)
        return F.when(at(i, "low") == at(i, "high"), at(i, "low")).otherwise((1.0 - share) * at(i, "low") + share * at(i, "high"))

    within = lambda i: (at(i + 1, "count") - at(i, "count")) / F.col("n")
    return told.select(F.col("key").alias(key), F.array(*[quantile(i, p) for i, p in enumerate(PREDICTIVE)]).alias("__q"), within(k).alias("p_within_10"), within(k + 2).alias("p_within_20"), F.col("n").alias("n_ratios"), (1.0 - at(k + 4, "count") / F.col("n")).alias("p_at_least_ask"))


def predictive(calibration: DataFrame, subjects: DataFrame, key: str, area: str, predicted: str, estimate: str, ratio: str, ask: str, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """Exact empirical distribution of estimate * (ratio of the subject's own calibration pool), with no draws.

    key, tier, n_ratios, value_qNN, p_within_10, p_within_20, p_at_least_ask of every subject; the distribution is null
    where the pool has fewer than LEAST_RATIOS ratios. A subject of unknown area or estimate gets the widest pool that fits. Pools
    that many subjects share (an area, everything) are summed up once; see own_bands for a subject's own price band."""
    # both are read many times
    calibration = written(calibration.select(area, predicted, ratio), "calibration")
    subjects = written(subjects.select(*dict.fromkeys([key, area, estimate, ask])), "subjects")
    tiers = subjects.join(calibration_pool(calibration, subjects, key, area, predicted, estimate).select(key, "tier"), key)
    tiers = written(tiers.withColumn("__ask", F.try_divide(F.col(ask), F.col(estimate))), "tiers")
    valid = calibration.where(F.col(ratio).isNotNull() & ~F.isnan(ratio) & (F.abs(F.col(ratio)) < math.inf)).select(F.col(area).alias("__area"), F.col(predicted).cast("double").alias("p"), F.col(ratio).cast("double").alias("v"))
    off = F.round(F.abs(F.col("v") - 1.0), 9)  # a ratio at a bound counts, whatever its last bit
    shape = [F.avg((off <= 0.1).cast("double")).alias("p_within_10"), F.avg((off <= 0.2).cast("double")).alias("p_within_20"), F.count("v").alias("n_ratios")]
    share = F.when(F.col("below").isNotNull(), 1.0 - F.col("below") / F.col("n_ratios")).alias("p_at_least_ask")
    asks = lambda t: tiers.where(F.col("tier") == t).select(key, F.col(area).alias("__area"), F.col("__ask").alias("v"), F.lit(False).alias("inclusive"))
    cols = [key, "__q", "p_within_10", "p_within_20", "n_ratios"]
    quantiled = lambda by: selected(valid, by, "v", PREDICTIVE).select(*by, F.col("q").alias("__q"))
    # only the tiers that some subject has are worked out
    used = {r["tier"] for r in tiers.select("tier").distinct().collect()}
    parts = []
    if used & {0, 2}:
        parts.append(own_bands(valid, tiers, key, area, estimate, most_pairs).select(*cols, "p_at_least_ask"))
    if 1 in used:
        local = valid.groupBy("__area").agg(*shape).join(quantiled(["__area"]), "__area")
        parts.append(asks(1).select(key, "__area").join(local, "__area").join(counts_below(valid, asks(1), ["__area"]).select(key, "below"), key, "left").select(*cols, share))
    if 3 in used:
        every = valid.agg(*shape).crossJoin(F.broadcast(quantiled([])))  # one row each
        parts.append(asks(3).select(key).crossJoin(F.broadcast(every)).join(counts_below(valid.select("v"), asks(3).drop("__area")).select(key, "below"), key, "left").select(*cols, share))
    enough = F.col("n_ratios") >= LEAST_RATIOS
    if parts:
        out = tiers.join(functools.reduce(DataFrame.unionByName, parts), key, "left")
    else:
        out = tiers.withColumns({"__q": F.lit(None).cast("array<double>"), **{c: F.lit(None).cast("double") for c in ("p_within_10", "p_within_20", "p_at_least_ask")}, "n_ratios": F.lit(None).cast("long")})
    out = out.withColumn("n_ratios", F.coalesce("n_ratios", F.lit(0).cast("long")))
    values = [F.when(enough, F.col(estimate) * F.col("__q")[i]).alias(f"value_q{round(p * 100):02d}") for i, p in enumerate(PREDICTIVE)]
    return out.select(key, "tier", "n_ratios", *values, *[F.when(enough, F.col(c)).alias(c) for c in ("p_within_10", "p_within_20", "p_at_least_ask")])


def simplex(k: int, steps: int = 10) -> list[tuple[float, ...]]:
    """Weights of k models, multiples of 1 / steps that sum to 1."""
    return [tuple(b - a - 1 for a, b in itertools.pairwise((-1, *bars, steps + k - 1))) for bars in itertools.combinations(range(steps + k - 1), k - 1)]


def blend_search(df: DataFrame, actual: str, models: Sequence[str], steps: int = 10) -> DataFrame:
    """combo (number of each weight), mae of every blend; one pass, one aggregate a combination."""
    grid = simplex(len(models), steps)
    err = lambda w: F.avg(F.abs(sum((F.col(m) * (k / steps) for m, k in zip(models, w, strict=True)), F.lit(0.0)) - F.col(actual)))
    one = df.agg(*[err(w).alias(f"c{i}") for i, w in enumerate(grid)])
    rows = [F.struct(*[F.lit(k).alias(f"w_{m}") for m, k in zip(models, w, strict=True)], F.col(f"c{i}").alias("mae")) for i, w in enumerate(grid)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def correction_search(df: DataFrame, actual: str, base: str, anchors: Sequence[str], steps: int = 100) -> DataFrame:
    """anchor, weight (in 1 / steps), mae of weight * base + (1 - weight) * anchor; a null anchor leaves the base."""
    each = df.select(F.col(actual).alias("__y"), F.col(base).alias("__b"), *anchors, F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("weight"))
    w = F.col("weight") / F.lit(float(steps))
    err = lambda a: F.avg(F.abs(F.coalesce(F.col("__b") * w + F.col(a) * (1 - w), F.col("__b")) - F.col("__y")))
    per = each.groupBy("weight").agg(*[err(a).alias(f"c{i}") for i, a in enumerate(anchors)])
    return per.select(F.explode(F.array(*[F.struct(F.lit(a).alias("anchor"), "weight", F.col(f"c{i}").alias("mae")) for i, a in enumerate(anchors)])).alias("r")).select("r.*")


def combined(validation: DataFrame, test: DataFrame, actual: str, models: Sequence[str], anchors: Sequence[str]) -> tuple[DataFrame, dict]:
    """test with `blend` and `corrected`, and what was chosen on the validation rows alone: the weights of the models' blend, and for the
    model of least error the anchor and weight of its correction. Both tables have the models' predictions and the anchors' values."""
    blend = blend_search(validation, actual, models).orderBy("mae", *[f"w_{m}" for m in models]).first()
    errors = validation.agg(*[F.avg(F.abs(F.col(m) - F.col(actual))).alias(m) for m in models]).first()
    base = min(models, key=lambda m: errors[m])
    fix = correction_search(validation, actual, base, anchors).orderBy("mae", "anchor", "weight").first()
    share = fix["weight"] / 100.0
    out = test.withColumns(
        {
            "blend": sum((F.col(m) * (blend[f"w_{m}"] / 10.0) for m in models), F.lit(0.0)),
            "corrected": F.coalesce(F.col(base) * share + F.col(fix["anchor"]) * (1.0 - share), F.col(base)),
        }
    )
    return out, {"blend": {**{m: blend[f"w_{m}"] / 10.0 for m in models}, "validation_mae": blend["mae"]}, "correction": {"base": base, "anchor": fix["anchor"], "weight": share, "validation_mae": fix["mae"]}}


def best(df: DataFrame, by: Sequence[str], value: str, tie: Sequence[str]) -> DataFrame:
    """The row of the smallest value of each group, first by `tie`."""
    w = W.partitionBy(*by).orderBy(value, *tie) if by else W.orderBy(value, *tie)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


#: Repetitions of the intervals and of the paired comparison.
INTERVAL_REPETITIONS, PAIR_REPETITIONS = 500, 1_000


def poisson_weight(digest: Column, part: int) -> Column:
    """Poisson(1) resampling weight from eight of an MD5's hexadecimal digits: the same in any engine.

    The weight is how many steps of the distribution the digits reach; as text of one length they compare as their numbers do."""
    digits, steps, p, total = F.substring(digest, 8 * part + 1, 8), [], math.exp(-1), 0.0
    for k in range(8):
        total += p
        steps.append(f"{math.ceil(total * 2**32):08x}")
        p /= k + 1
    out = F.lit(8)
    for k in reversed(range(8)):  # the first steps are looked at first: most weights are small
        out = F.when(digits < steps[k], k).otherwise(out)
    return out


def bootstrap_mae(df: DataFrame, key: str, errors: Sequence[str], repetitions: int) -> DataFrame:
    """rep and mae_<model>: weighted mean absolute errors under shared resamples (rows are resampled jointly).

    One MD5 of (repetition div 4, id) gives the weights of four repetitions, so a row is repeated a quarter as often."""
    # numbered partitions: the planner would merge few bytes into a task or two, and these rows are repeated hundreds of times
    rows = df.select(key, *errors).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    each = rows.select(key, *errors, F.explode(F.sequence(F.lit(0), F.lit((repetitions - 1) // 4))).alias("four")).withColumn("digest", F.md5(F.concat_ws("|", F.col("four").cast("string"), F.col(key).cast("string"))))
    each = each.select("four", *errors, *[poisson_weight(F.col("digest"), j).alias(f"w{j}") for j in range(4)])
    sums = each.groupBy("four").agg(*[F.sum(f"w{j}").alias(f"n{j}") for j in range(4)], *[F.sum(F.col(e) * F.col(f"w{j}")).alias(f"s{j}_{e}") for j in range(4) for e in errors])
    parts = [F.struct((F.col("four") * 4 + j).alias("rep"), *[(F.col(f"s{j}_{e}") / F.col(f"n{j}")).alias(f"mae_{e}") for e in errors]) for j in range(4)]
    return sums.select(F.explode(F.array(*parts)).alias("r")).select("r.*").where(F.col("rep") < repetitions)


def bootstrap_intervals(df: DataFrame, key: str, errors: Sequence[str], repetitions: int = INTERVAL_REPETITIONS, baseline: str | None = None) -> DataFrame:
    """model, low and high of its MAE, and of its reduction against the baseline, the first model by default (95 %)."""
    baseline = baseline or errors[0]
    gain = lambda e: F.col(f"mae_{baseline}") - F.col(f"mae_{e}")
    both = F.array(F.lit(0.025), F.lit(0.975))
    one = bootstrap_mae(df, key, errors, repetitions).agg(*[F.percentile(c, both).alias(n) for e in errors for n, c in ((f"m_{e}", F.col(f"mae_{e}")), (f"g_{e}", gain(e)))])
    rows = [F.struct(F.lit(e).alias("model"), F.col(f"m_{e}")[0].alias("mae_low"), F.col(f"m_{e}")[1].alias("mae_high"), F.col(f"g_{e}")[0].alias("gain_low"), F.col(f"g_{e}")[1].alias("gain_high")) for e in errors]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def paired_bootstrap(df: DataFrame, key: str, errors: Sequence[str], repetitions: int = PAIR_REPETITIONS) -> DataFrame:
    """All pairs of models: mean difference of MAE, its 95 % interval, and whether that leaves 0 out."""
    reps = bootstrap_mae(df, key, errors, repetitions)
    cells = [F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), (F.col(f"mae_{a}") - F.col(f"mae_{b}")).alias("diff")) for a in errors for b in errors if a != b]
    long = reps.select(F.explode(F.array(*cells)).alias("r")).select("r.*")
    out = long.groupBy("model_a", "model_b").agg(F.avg("diff").alias("mean_diff"), F.percentile("diff", F.lit(0.025)).alias("low"), F.percentile("diff", F.lit(0.975)).alias("high"))
    return out.withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0))


def square_matrix(pairs: DataFrame, row: str, column: str, value: str, names: Sequence[str]) -> DataFrame:
    return pairs.groupBy(row).pivot(column, list(names)).agg(F.first(value))


def missing_rates(df: DataFrame) -> DataFrame:
    """column, rate: share of nulls of every column, from one pass."""
    one = df.agg(*[F.round(F.avg(F.col(f"`{c}`").isNull().cast("double")), 6).alias(f"m{i}") for i, c in enumerate(df.columns)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("rate")) for i, c in enumerate(df.columns)])).alias("r")).select("r.*")


def ranked(df: DataFrame, value: str, tie: str) -> DataFrame:
    """rank by value. For short lists of models: the window is one partition."""
    return df.withColumn("rank", F.row_number().over(W.orderBy(value, tie)))


def top_within(df: DataFrame, by: Sequence[str], value: str, tie: str, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.col(value).desc(), tie))).where(F.col("rank") <= k)


def hashed_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the first by an MD5 of id and seed: reproducible in any engine."""
    return df.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)
