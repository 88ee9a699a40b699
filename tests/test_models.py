"""Selection, boosting and ordered target statistics against plain Python."""

from __future__ import annotations

import datetime as dt
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from propval.operators import boosting, encoding, ml, selection

PROBS = [0.0, 0.05, 0.333, 0.5, 0.9, 1.0]


def test_selection_equals_percentiles(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(size=500) * 1e-12, rng.lognormal(3, 2, 500), -rng.integers(0, 5, 500), np.full(700, 7.0)])
    rows = [(int(g) if g < 3 else None, float(v)) for g, v in zip(rng.integers(0, 4, len(values)), values)]
    rows += [(7, None), (8, 5.0), (9, float("nan")), (0, float("inf"))]
    df = spark.createDataFrame(rows, "g int, v double").repartition(5)
    want = {r["g"]: r["q"] for r in df.where("NOT isnan(v)").groupBy("g").agg(F.percentile("v", F.array(*[F.lit(p) for p in PROBS])).alias("q")).where("q IS NOT NULL").collect()}
    assert {r["g"]: r["q"] for r in selection.selected(df, ["g"], "v", PROBS).collect()} == want
    assert selection.selected_few(df, "g", "v", PROBS) == want
    assert selection.selected(df.limit(0), [], "v", PROBS).count() == 0 and selection.selected_few(df.limit(0), None, "v", PROBS) == {}
    both = selection.selected_columns(spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double"), ["a", "b"], [0.5]).collect()
    assert [(r["column"], r["n"], r["q"]) for r in both] == [("a", 2, [1.5])]


def test_buckets_never_fall(spark):
    rng = np.random.default_rng(1)
    values = np.sort(np.concatenate([rng.normal(size=2000), rng.lognormal(0, 20, 2000), -rng.lognormal(0, 20, 2000), [0.0, -0.0]]))
    got = [r[0] for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double").select(selection.bucket(F.col("v")), "i").sort("i").collect()]
    assert got == sorted(got)


def sales(spark, n=600):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        surface, kind = float(rng.integers(20, 120)), "abcdefgh"[int(rng.integers(8))]
        price = surface * (3000 + 900 * "hcaebgdf".index(kind)) * math.exp(rng.normal() * 0.1) * (5.0 if i % 50 == 0 else 1.0)
        rows.append((i, surface if i % 17 else None, kind if i % 23 else None, price, surface))
    return spark.createDataFrame(rows, "id int, size double, kind string, price double, surface double")


def test_boosting_learns_numbers_categories_and_missing_values(spark):
    df = sales(spark)
    train, test = df.where("id % 4 <> 0").persist(), df.where("id % 4 = 0 AND id % 50 <> 0").persist()
    spec = ml.Spec(["size"], ["kind"])
    errors = {}
    for loss in ("squared", "absolute", "huber"):
        model = boosting.fit(train, spec, boosting.Config(loss=loss, rounds=6, rate=0.5, depth=3, bins=16, min_leaf=5, l2=1.0))
        again = boosting.Model.from_json(model.to_json())
        out = boosting.predict(again, test).collect()
        assert [r["prediction"] for r in out] == [r["prediction"] for r in boosting.predict(model, test).collect()] and len(out) == test.count()
        errors[loss] = float(np.mean([abs(r["prediction"] - r["price"]) for r in out]))
    level = test.agg(F.avg(F.abs(F.col("price") - F.lit(train.agg(F.median("price")).first()[0])))).first()[0]
    assert max(errors.values()) < 0.45 * level and min(errors["absolute"], errors["huber"]) < errors["squared"]
    # a level never seen, no value at all, a column of an inner name
    odd = spark.createDataFrame([(1, 50.0, "zz", 1.0, 50.0, 3), (2, None, None, 1.0, 50.0, 4)], "id int, size double, kind string, price double, surface double, x int")
    assert [r["prediction"] > 0 for r in boosting.predict(model, odd).collect()] == [True, True]


def test_leaves_are_the_losses_minimisers(spark):
    df = sales(spark, 300).withColumn("kind", F.lit("a"))
    y = {r["id"]: math.log1p(r["price"]) for r in df.collect()}
    for loss in ("absolute", "huber"):
        model = boosting.fit(df, ml.Spec(["size"]), boosting.Config(loss=loss, rounds=1, rate=1.0, depth=2, bins=8, min_leaf=10, l2=3.0))
        tree = model.trees[0]
        ends = {r["id"]: r["node"] for r in df.select("id", boosting.binned(model, df).alias("__x")).select("id", boosting.node_of(tree.splits, model).alias("node")).collect()}
        residual = defaultdict(list)
        for i, k in ends.items():
            residual[k].append(y[i] - model.base)
        bound = float(np.quantile(np.abs([v - model.base for v in y.values()]), 0.9))
        assert set(residual) == {k for k, n in tree.rows.items() if n} and model.base == pytest.approx(float(np.median(list(y.values()))))
        for k, r in residual.items():
            m = float(np.median(r))
            off = np.array(r) - m
            v = m + (float(np.mean(np.sign(off) * np.minimum(np.abs(off), bound))) if loss == "huber" else 0.0)
            assert tree.leaves[k] == pytest.approx(v * len(r) / (len(r) + 3.0)) and tree.rows[k] == len(r)


def test_validation_ends_boosting(spark):
    df = sales(spark)
    model = boosting.fit(df.where("id % 3 <> 0"), ml.Spec(["size"]), boosting.Config(rounds=12, rate=1.0, depth=3, bins=16, min_leaf=2, patience=2), df.where("id % 3 = 0"))
    assert len(model.errors) < 12 and len(model.trees) == int(np.argmin(model.errors)) + 1


def brute(rows, lag, strength):
    out = {}
    for i, k, d, _ in rows:
        old = [(b, y) for _, b, e, y in rows if e is not None and d is not None and y is not None and e <= d - dt.timedelta(days=lag)]
        own = [y for b, y in old if b == k and k is not None]
        prior = sum(y for _, y in old) / len(old) if old else None
        out[i] = (len(own), None if prior is None else (sum(own) + strength * prior) / (len(own) + strength))
    return out


@pytest.mark.parametrize("span", [1, 30, 100_000])
def test_ordered_statistics_equal_brute_force(spark, span):
    rng = np.random.default_rng(4)
    day = lambda: dt.date(2021, 1, 1) + dt.timedelta(days=int(rng.integers(0, 700)))
    rows = [(i, (["hot"] * 3 + ["a", "b", None])[int(rng.integers(6))], day(), float(rng.normal())) for i in range(250)]
    rows += [(1000, "a", None, 1.0), (1001, "b", dt.date(2022, 1, 1), None), (1002, "new", dt.date(2022, 6, 1), 2.0), (1003, "a", dt.date(1900, 1, 1), None)]
    df = spark.createDataFrame(rows, "id int, key string, day date, y double").withColumn("n", F.lit("own"))
    got = {r["id"]: (r["key__n"], r["key__mean"]) for r in encoding.ordered_target_stats(df, ["key"], "day", F.col("y"), 90, 10.0, span).collect()}
    want = brute(rows, 90, 10.0)
    assert {i: n for i, (n, _) in got.items()} == {i: n for i, (n, _) in want.items()}
    assert all((a is None) == (want[i][1] is None) and (a is None or a == pytest.approx(want[i][1])) for i, (_, a) in got.items())
    assert encoding.ordered_target_stats(df.limit(0), ["key"], "day", F.col("y")).count() == 0


def test_identity_as_statistics_helps(spark):
    """Prices depend on the building, of which there are too many for levels of their own."""
    rng = np.random.default_rng(6)
    worth = np.exp(rng.normal(size=150) * 0.5)
    rows = [(i, f"B{b}", dt.date(2019, 1, 1) + dt.timedelta(days=int(i * 1.2)), float(s), float(s * 4000 * worth[b] * math.exp(rng.normal() * 0.05))) for i, (b, s) in enumerate(zip(rng.integers(0, 150, 1500), rng.integers(20, 100, 1500)))]
    df = spark.createDataFrame(rows, "id int, building_id string, day date, surface double, price double")
    df = encoding.ordered_target_stats(df, ["building_id"], "day", F.log1p(F.col("price") / F.col("surface")), strength=1.0).persist()
    error = {}
    for name, numeric in (("no_identity", ["surface"]), ("identity", ["surface", "building_id__mean", "building_id__n"])):
        model = boosting.fit(df.where("id < 1200"), ml.Spec(numeric, target="ppm2"), boosting.Config(loss="huber", rounds=6, rate=0.5, depth=4, bins=32, min_leaf=10))
        error[name] = ml.mae(boosting.predict(model, df.where("id >= 1200")), "price", "prediction")
    assert error["identity"] < 0.6 * error["no_identity"]


@pytest.mark.parametrize("n", [0, 20, 1500])
def test_band_statistics_equal_brute_force(spark, n):
    """Ranks in a tree of no, one and two levels; ties of place and value, empty bands, bounds beyond all values."""
    from propval.operators import bands

    rng = np.random.default_rng(n)
    rows = [("a" if i % 5 else "b", float(p), float(v)) for i, (p, v) in enumerate(zip(np.round(rng.lognormal(4, 1, n)), np.round(rng.normal(1, 0.2, n), 2)))]
    asks = [(i, "abc"[i % 3], float(x), float(x * rng.uniform(1, 3)), (-9.0, 9.0, float(np.round(rng.normal(1, 0.2), 2)))[i % 3]) for i, x in enumerate(np.round(rng.lognormal(4, 1, 40)))]
    probs = [0.0, 0.3, 0.95, 1.0]
    seeks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("share"), F.lit(None).cast("double").alias("bound")) for i, p in enumerate(probs)], F.struct(F.lit(4).alias("i"), F.lit(None).cast("double").alias("share"), F.col("b").alias("bound")))
    df = spark.createDataFrame(asks, "key int, g string, low double, high double, b double").select("key", "g", "low", "high", seeks.alias("seeks"))
    got = {r["key"]: r for r in bands.band_statistics(spark.createDataFrame(rows, "g string, p double, v double").repartition(3), df).collect()}
    for key, g, low, high, bound in asks:
        inside = sorted(v for h, p, v in rows if h == g and low <= p <= high)
        if not inside:
            assert key not in got
            continue
        assert got[key]["n"] == len(inside)
        for x, p in zip(got[key]["found"], probs):
            at = p * (len(inside) - 1)
            assert (x["low"], x["high"]) == (inside[math.floor(at)], inside[math.ceil(at)])
        assert got[key]["found"][4]["count"] == sum(v < bound for v in inside)


def test_band_statistics_over_blocks_of_values_and_parts_of_asks(spark, monkeypatch):
    """Most bands reach the last place and every value is frequent; the results are exact however a group is cut."""
    from propval.operators import bands

    monkeypatch.setattr(bands, "BLOCK_ROWS", 50)
    monkeypatch.setattr(bands, "PART_ASKS", 20)
    rng = np.random.default_rng(3)
    rows = [("a" if i % 5 else "b", float(p), float(v)) for i, (p, v) in enumerate(zip(rng.integers(0, 40, 800), rng.integers(0, 9, 800)))]
    asks = [(i, "ab"[i % 2], float(rng.integers(-9, 30)), 99.0 if i % 3 else 20.0, float(rng.integers(-1, 11)), float(rng.random())) for i in range(90)]
    seeks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(None).cast("double").alias("share") if c == "b" else F.col(c).alias("share"), F.col("b").alias("bound") if c == "b" else F.lit(None).cast("double").alias("bound")) for i, c in enumerate(["s", "b"])])
    df = spark.createDataFrame(asks, "key int, g string, low double, high double, b double, s double").select("key", "g", "low", "high", seeks.alias("seeks"))
    got = {r["key"]: r for r in bands.band_statistics(spark.createDataFrame(rows, "g string, p double, v double").repartition(3), df).collect()}
    for key, g, low, high, bound, share in asks:
        inside = sorted(v for h, p, v in rows if h == g and low <= p <= high)
        if not inside:
            assert key not in got
            continue
        at = share * (len(inside) - 1)
        x = got[key]["found"]
        assert (got[key]["n"], x[0]["low"], x[0]["high"], x[1]["count"]) == (len(inside), inside[math.floor(at)], inside[math.ceil(at)], sum(v < bound for v in inside))


def test_predictive_is_the_same_by_ranks_and_by_pairs(spark):
    from propval.operators import stats

    rng = np.random.default_rng(9)
    past = [("ab"[i % 2] if i % 40 else "c", float(p), float(r)) for i, (p, r) in enumerate(zip(rng.lognormal(12, 0.6, 900), np.round(rng.normal(1, 0.15, 900), 3)))]
    own = [(i, ("a", "b", "c", None)[i % 4], float(e), float(e * rng.uniform(0.8, 1.2)) if i % 7 else None) for i, e in enumerate(rng.lognormal(12, 0.6, 60))]
    calibration = spark.createDataFrame(past, "area string, predicted double, ratio double")
    subjects = spark.createDataFrame(own, "id int, area string, estimate double, ask double")
    got = [{r["id"]: r for r in stats.predictive(calibration, subjects, "id", "area", "predicted", "estimate", "ratio", "ask", most).collect()} for most in (10**9, 0)]
    assert set(got[0]) == set(got[1]) == set(range(60)) and {r["tier"] for r in got[0].values()} >= {0, 2}
    for i, r in got[0].items():
        for c, v in r.asDict().items():
            assert got[1][i][c] == (v if v is None or isinstance(v, int) else pytest.approx(v)), (i, c)


def test_configurations_share_their_training_rows(spark, monkeypatch):
    """A search imputes the development rows once and the final rows once, whatever the number of configurations; each fit is as on its own."""
    df = sales(spark, 300).withColumn("size", F.when(F.col("id") % 7 != 0, F.col("size")))
    calls, inner = [], ml.exact_medians
    monkeypatch.setattr(ml, "exact_medians", lambda *a: calls.append(1) or inner(*a))
    spec = ml.Spec(["size"])
    fitted, log = ml.select_and_refit(["ridge"], {"one": spec}, df.where("id % 3 = 0"), df.where("id % 3 = 1"), df.where("id % 3 < 2"))
    assert len(calls) == 2 and len(log) == 4
    best = min(log, key=lambda t: t["mae"])
    alone = ml.fit("ridge", best["config"], df.where("id % 3 < 2"), spec)
    assert alone.medians == fitted["ridge_one"].medians
    got = [[r["prediction"] for r in ml.predict(f, df).orderBy("id").collect()] for f in (alone, fitted["ridge_one"])]
    assert got[0] == pytest.approx(got[1])


def test_rounds_read_the_rows_of_the_round_before_alone(spark):
    """Batches are routed as the expression routes rows, also for bins never split on; of the rounds' tables only the last is left."""
    from propval import session

    df = sales(spark, 300).withColumn("kind", F.lit("a"))
    known = session.tables_written()
    model = boosting.fit(df, ml.Spec(["size"], ["kind"]), boosting.Config(loss="huber", rounds=3, rate=0.5, depth=3, bins=8, min_leaf=10))
    assert len([t for t in session.tables_written() - known if "boost-rows" in t]) == 1
    odd = df.unionByName(df.limit(3).withColumns({"size": F.lit(None).cast("double"), "kind": F.lit("new")}))
    for tree in model.trees:
        rows = odd.select(F.lit(0.0).alias("__y"), F.lit(0.0).alias("__f"), boosting.binned(model, odd).cast("array<int>").alias("__x"))
        got = boosting.routed(rows, tree.splits, model).withColumn("want", boosting.node_of(tree.splits, model)).select("node", "want").collect()
        assert len(got) == 303 and all(r["node"] == r["want"] for r in got)


def test_the_categorical_booster_is_fitted_whole_and_hundreds_of_trees_are_no_plan(spark):
    """The reference's rounds, rate, depth and penalty; scores of many trees equal the expression of each."""
    from propval.plans.queries import CATEGORICAL

    assert (CATEGORICAL.rounds, CATEGORICAL.rate, CATEGORICAL.depth, CATEGORICAL.l2, CATEGORICAL.patience) == (650, 0.05, 7, 5.0, 0)
    spec = ml.Spec(["size"], ["kind"], target="total")
    config = boosting.Config(rounds=400, rate=0.05, depth=2, bins=8)
    tree = lambda k: boosting.Tree({0: boosting.Split(0, "size", list(range(k % 5)) or [0], 1.0), 2: boosting.Split(2, "kind", [0, 2], 1.0)}, {1: 0.01 * k, 5: -0.02, 6: 0.001 * k}, {})
    model = boosting.Model(spec, config, {"size": [1.0, 2.0, 3.0, 4.0]}, {"kind": ["a", "b"]}, 1.0, [tree(k) for k in range(400)])
    df = spark.createDataFrame([(i, [None, 0.5, 1.5, 2.5, 3.5, 9.0][i % 6], ["a", "b", "c", None][i % 4]) for i in range(48)], "id int, size double, kind string").coalesce(2)
    got = {r.id: r.prediction for r in boosting.predict(model, df).collect()}
    few = boosting.Model(spec, config, model.edges, model.levels, model.base, model.trees[:5])
    one = df.withColumn("__x", boosting.binned(few, df)).withColumn("f", sum((boosting.value_of(t, few) for t in few.trees), F.lit(1.0)))
    want = {r.id: r.f for r in one.collect()}
    assert len(got) == 48 and {r.id: r.prediction for r in boosting.predict(few, df).collect()} == {k: pytest.approx(max(math.expm1(v), 0.0)) for k, v in want.items()}
    assert len(boosting.predict(model, df)._jdf.queryExecution().optimizedPlan().toString()) < 20_000
