"""Gradient boosting from distributed histograms: squared, absolute and Huber loss, penalised leaves, native categories.

Features are binned once: numbers at quantiles of the training rows, missing values apart, categories by level. A level
of a tree is one pass, in which each task adds up its rows' negative gradients by node, feature and bin; summed over the tasks, at most
nodes x features x bins rows come back, however many rows there are. After a tree the rows are written out with their node: leaves and the next
round read that and not the trees before. Categories are split over their levels in the order of their mean
gradients, so any subset that such an order can cut off may go left. Leaves take the loss's own minimiser: means, exact medians, or the median
plus the mean of what Huber's bounds leave, shrunk by n / (n + l2).

Ties go to the first feature and bin; gains count to GAIN_DIGITS digits, so the order of summation does not show.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propval.operators.ml import Spec, inverse_column, target_column
from propval.operators.selection import selected_few
from propval.session import drop_written, tables_written, written

#: Gains are compared to so many decimals of the loss's own scale.
GAIN_DIGITS = 6
#: Bins need no exact quantiles: one mergeable sketch a column does.
EDGE_ACCURACY = 100_000
#: Training rows that a task is worth.
ROWS_OF_TASK = 100_000
#: After so many trees the validation rows are written out and their plan starts anew.
TREES_OF_PLAN = 5


@dataclass
class Config:
    loss: str = "squared"  # squared, absolute or huber
    rounds: int = 100
    rate: float = 0.1
    depth: int = 5
    bins: int = 64
    min_leaf: int = 20
    l2: float = 0.0
    #: Huber's bound is this quantile of the absolute residuals, taken anew each round.
    alpha: float = 0.9
    #: Levels of a category that count on their own, the most frequent; all others share one.
    max_levels: int = 254
    #: Stop when the validation error has not fallen for so many rounds.
    patience: int = 0


@dataclass
class Split:
    """Goes left if the feature's bin is in `left`. A number's are all bins up to one."""

    node: int
    feature: str
    left: list[int]
    gain: float


@dataclass
class Tree:
    splits: dict[int, Split]
    leaves: dict[int, float]
    rows: dict[int, int]


@dataclass
class Model:
    spec: Spec
    config: Config
    edges: dict[str, list[float]]
    levels: dict[str, list[str]]
    base: float
    trees: list[Tree] = field(default_factory=list)
    seconds: float = 0.0
    errors: list[float] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Model:
        d = json.loads(text)
        whole = lambda m: {int(k): v for k, v in m.items()}
        trees = [Tree({k: Split(**s) for k, s in whole(t["splits"]).items()}, whole(t["leaves"]), whole(t["rows"])) for t in d["trees"]]
        return Model(Spec(**d["spec"]), Config(**d["config"]), d["edges"], d["levels"], d["base"], trees, d["seconds"], d["errors"])

    def features(self) -> list[str]:
        return [*self.spec.numeric, *self.spec.categorical]


def bin_of(v: Column, edges: Sequence[float]) -> Column:
    """0 for missing, else 1 + the number of edges below v, by halving."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low + 1)
        mid = (low + high) // 2
        return F.when(v <= float(edges[mid]), among(low, mid)).otherwise(among(mid + 1, high))

    return F.when(v.isNull() | F.isnan(v), 0).otherwise(among(0, len(edges)))


def level_of(v: Column, levels: Sequence[str]) -> Column:
    """0 for missing, 1 for a level without a number of its own, else its number from 2."""
    if not levels:
        return F.when(v.isNull(), 0).otherwise(1)
    numbers = F.create_map(*[x for i, level in enumerate(levels) for x in (F.lit(level), F.lit(i + 2))])
    return F.when(v.isNull(), 0).otherwise(F.coalesce(F.try_element_at(numbers, v), F.lit(1)))


def binned(model: Model, df: DataFrame) -> Column:
    """The array of a row's bins, in the order of the features."""
    numbers = [bin_of(F.col(c).cast("double"), model.edges[c]) for c in model.spec.numeric]
    return F.array(*numbers, *[level_of(F.col(c).cast("string"), model.levels[c]) for c in model.spec.categorical])


def edges_of(df: DataFrame, columns: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Distinct inner quantiles of each column, exact up to about EDGE_ACCURACY rows and to so small a share of the rows beyond."""
    if not columns:
        return {}
    probs = F.expr(f"array({','.join(str(i / bins) for i in range(1, bins))})")
    at = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    row = df.agg(*[F.percentile_approx(at(c), probs, EDGE_ACCURACY).alias(f"q{i}") for i, c in enumerate(columns)]).first()
    return {c: sorted(set(row[f"q{i}"] or [])) for i, c in enumerate(columns)}


def levels_of(df: DataFrame, columns: Sequence[str], at_most: int) -> dict[str, list[str]]:
    """The most frequent levels of each column, the first by name of equally frequent ones."""
    out = {}
    for c in columns:
        n = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("n"))
        out[c] = [r["level"] for r in n.orderBy(F.desc("n"), "level").limit(at_most).collect()]
    return out


def array_of(values: Iterable[str]) -> Column:
    """A constant array from SQL literals, in one call."""
    return F.expr(f"array({','.join(values)})")


def node_of(splits: dict[int, Split], model: Model) -> Column:
    """The node at which a row ends; children of node k are 2k + 1 and 2k + 2.

    A tree is data, arrays by node, not code: so the code that Spark generates is the same for every tree and compiled once."""
    places = {c: i for i, c in enumerate(model.features())}
    size = max(splits, default=0) + 1
    longest = max((s.left[-1] + 1 for s in splits.values()), default=1)
    place = array_of(str(places[splits[k].feature]) if k in splits else "-1" for k in range(size))
    left = array_of("array(" + ",".join(str(k in splits and x in set(splits[k].left)).lower() for x in range(longest)) + ")" for k in range(size))

    def down(node: Column, _: Column) -> Column:
        at = F.coalesce(F.get(place, node), F.lit(-1))
        goes_left = F.coalesce(F.get(F.get(left, node), F.get(F.col("__x"), at)), F.lit(False))
        return F.when(at < 0, node).otherwise(2 * node + F.when(goes_left, 1).otherwise(2))

    return F.aggregate(F.sequence(F.lit(1), F.lit(model.config.depth)), F.lit(0), down)


def value_of(tree: Tree, model: Model) -> Column:
    values = array_of(f"double('{float(tree.leaves.get(k, 0.0))!r}')" for k in range(max(tree.leaves, default=0) + 1))
    return F.coalesce(F.get(values, node_of(tree.splits, model)), F.lit(0.0))


def gradient(loss: str, residual: np.ndarray, bound: float) -> np.ndarray:
    """Negative gradient of the loss."""
    if loss == "squared":
        return residual
    return np.sign(residual) if loss == "absolute" else np.clip(residual, -bound, bound)


class Router:
    """`node_of` for a batch of rows (a matrix of their bins)."""

    def __init__(self, splits: dict[int, Split], model: Model) -> None:
        places = {c: i for i, c in enumerate(model.features())}
        size, self.longest = 2 * max(splits, default=0) + 3, max((s.left[-1] + 1 for s in splits.values()), default=1)
        self.place, self.left, self.depth = np.full(size, -1), np.zeros((size, self.longest), dtype=bool), model.config.depth if splits else 0
        for k, s in splits.items():
            self.place[k] = places[s.feature]
            self.left[k, s.left] = True

    def __call__(self, bins: np.ndarray) -> np.ndarray:
        node, each = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
        for _ in range(self.depth):
            at = self.place[node]
            own = bins[each, np.maximum(at, 0)]
            goes_left = self.left[node, np.minimum(own, self.longest - 1)] & (own < self.longest)
            node = np.where(at < 0, node, 2 * node + np.where(goes_left, 1, 2))
        return node


def bins_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch["__x"].flatten().to_numpy().reshape(batch.num_rows, -1)


def best_split(node: int, rows: dict[int, list[tuple[int, float, int]]], model: Model) -> Split | None:
    """rows: for each feature's place its (bin, sum of gradients, count). The split of greatest gain, if any gains."""
    config, best = model.config, None
    for place, name in enumerate(model.features()):
        cells = rows.get(place, [])
        if len(cells) < 2:
            continue
        b, g, n = (np.array(c) for c in zip(*cells, strict=True))
        order = np.lexsort((b, np.round(g / n, 9))) if place >= len(model.spec.numeric) else np.argsort(b)
        left_g, left_n = np.cumsum(g[order])[:-1], np.cumsum(n[order])[:-1]
        all_g, all_n = g.sum(), n.sum()
        score = lambda s, c: s * s / (c + config.l2)
        gain = score(left_g, left_n) + score(all_g - left_g, all_n - left_n) - score(all_g, all_n)
        gain = np.where((left_n >= config.min_leaf) & (all_n - left_n >= config.min_leaf), np.round(gain, GAIN_DIGITS), -math.inf)
        k = int(np.argmax(gain))
        if gain[k] > 0 and (best is None or gain[k] > best.gain):
            left = [int(x) for x in b[order][: k + 1]]
            best = Split(node, name, sorted(left) if place >= len(model.spec.numeric) else list(range(left[-1] + 1)), float(gain[k]))
    return best


def histogram(state: DataFrame, splits: dict[int, Split], open_: Sequence[int], model: Model, bound: float) -> DataFrame:
    """node, feature's place, bin, sum of gradients, count of the open nodes' rows; state: __y, __f, __x (the bins)."""
    route, loss = Router(splits, model), model.config.loss
    wide = max([1, *(len(e) + 2 for e in model.edges.values()), *(len(v) + 2 for v in model.levels.values())])
    features = len(model.features())
    slot = np.full(2 * max(open_) + 3, -1)
    slot[list(open_)] = np.arange(len(open_))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, n = np.zeros(len(open_) * features * wide), np.zeros(len(open_) * features * wide, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows or not features:
                continue
            bins = bins_of(batch)
            node = route(bins)
            own = np.where(node < len(slot), slot[np.minimum(node, len(slot) - 1)], -1)
            kept = own >= 0
            up = gradient(loss, batch["__y"].to_numpy() - batch["__f"].to_numpy(), bound)[kept]
            for place in range(features):
                cell = (own[kept] * features + place) * wide + bins[kept, place]
                g += np.bincount(cell, up, len(g))
                n += np.bincount(cell, minlength=len(n))
        cell = np.flatnonzero(n)
        node, place, at = np.array(open_)[cell // (features * wide)] if len(cell) else cell, cell // wide % max(features, 1), cell % wide
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int32()), pa.array(place, pa.int32()), pa.array(at, pa.int32()), pa.array(g[cell]), pa.array(n[cell])], names=["node", "place", "bin", "g", "n"])

    cells = state.select("__y", "__f", "__x").mapInArrow(add, "node int, place int, bin int, g double, n bigint")
    return cells.groupBy("node", "place", "bin").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))


def routed(state: DataFrame, splits: dict[int, Split], model: Model) -> DataFrame:
    """state with the node at which each row ends."""
    route = Router(splits, model)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = route(bins_of(batch)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("__y", "__f", "__x")), pa.array(node, pa.int32())], names=["__y", "__f", "__x", "node"])

    return state.select("__y", "__f", "__x").mapInArrow(add, "__y double, __f double, __x array<int>, node int")


def grow(state: DataFrame, model: Model, bound: float) -> tuple[Tree, DataFrame]:
    """One tree on the rows of state: __y, __f (predicted so far), __x (bins); and these rows, written, with their node."""
    config = model.config
    places = {c: i for i, c in enumerate(model.features())}
    splits: dict[int, Split] = {}
    sums: dict[int, tuple[float, int]] = {}
    open_ = [0]
    for _ in range(config.depth):
        cells: dict[int, dict[int, list]] = {k: {} for k in open_}
        for r in sorted(histogram(state, splits, open_, model, bound).collect()):  # at most nodes x features x bins
            cells[r["node"]].setdefault(r["place"], []).append((r["bin"], r["g"], r["n"]))
        found = [s for k in open_ if (s := best_split(k, cells[k], model))]
        for k in open_:
            whole = cells[k].get(0, [])
            sums[k] = (sum(c[1] for c in whole), sum(c[2] for c in whole))
        for s in found:
            splits[s.node] = s
            cell = {b: (g, n) for b, g, n in cells[s.node][places[s.feature]]}
            left = [cell[b] for b in s.left if b in cell]
            g, n = sum(c[0] for c in left), sum(c[1] for c in left)
            sums[2 * s.node + 1], sums[2 * s.node + 2] = (g, n), (sums[s.node][0] - g, sums[s.node][1] - n)
        open_ = [k for s in found for k in (2 * s.node + 1, 2 * s.node + 2)]
        if not open_:
            break
    ends = {k: n for k, (_, n) in sums.items() if k not in splits}
    shrunk = lambda k, v: v * ends[k] / (ends[k] + config.l2) if ends[k] else 0.0
    rows = written(routed(state, splits, model), "boost-rows")
    if config.loss == "squared":
        leaves = {k: sums[k][0] / (ends[k] + config.l2) if ends[k] else 0.0 for k in ends}
    else:
        at = rows.select("node", (F.col("__y") - F.col("__f")).alias("r"))
        middle = {k: q[0] for k, q in selected_few(at, "node", "r", [0.5]).items()}
        more = {}
        if config.loss == "huber":
            medians = array_of(f"double('{float(middle.get(k, 0.0))!r}')" for k in range(max(ends) + 1))
            off = F.col("r") - F.get(medians, F.col("node"))
            more = {r["node"]: r["v"] for r in at.groupBy("node").agg(F.avg(F.signum(off) * F.least(F.abs(off), F.lit(bound))).alias("v")).collect()}
        leaves = {k: shrunk(k, middle.get(k, 0.0) + more.get(k, 0.0)) for k in ends}
    return Tree(splits, {k: float(v) for k, v in leaves.items()}, ends), rows


def fit(train: DataFrame, spec: Spec, config: Config, validation: DataFrame | None = None) -> Model:
    """Fits on the rows whose target exists. With validation rows and patience, the rounds up to the least validation error of the price stay."""
    start = time.perf_counter()
    train = train.withColumn("__y", target_column(spec)).where(F.col("__y").isNotNull() & ~F.isnan("__y"))
    columns = dict.fromkeys(["__y", *spec.numeric, *spec.categorical])
    train = written(train.select(*columns), "boost-train")
    model = Model(spec, config, edges_of(train, spec.numeric, config.bins), levels_of(train, spec.categorical, config.max_levels), 0.0)
    if config.loss == "squared":
        model.base = float(train.agg(F.avg("__y")).first()[0] or 0.0)
    else:
        model.base = selected_few(train, None, "__y", [0.5]).get(0, [0.0])[0]
    tasks = max(1, -(-train.count() // ROWS_OF_TASK))
    known = tables_written()
    state = written(train.repartition(tasks).select(F.col("__y"), F.lit(model.base).alias("__f"), binned(model, train).cast("array<int>").alias("__x")), "boost-rows")
    last = tables_written() - known
    checked = None
    if validation is not None and config.patience:
        checked = written(validation.select(F.col(spec.price).cast("double").alias("__price"), *[c for c in (spec.surface, spec.anchor) if c in validation.columns], F.lit(model.base).alias("__f"), binned(model, validation).alias("__x")), "boost-check")
    best, left = math.inf, config.patience
    for k in range(config.rounds):
        bound = 0.0
        if config.loss == "huber":
            bound = selected_few(state.select(F.abs(F.col("__y") - F.col("__f")).alias("r")), None, "r", [config.alpha]).get(0, [0.0])[0]
        known = tables_written()
        tree, rows = grow(state, model, bound)
        drop_written(train.sparkSession, last)  # the new rows hold all of it
        last = tables_written() - known
        tree.leaves = {n: v * config.rate for n, v in tree.leaves.items()}
        if not tree.splits and not any(tree.leaves.values()):
            break
        model.trees.append(tree)
        add = lambda df: df.withColumn("__f", F.col("__f") + value_of(tree, model))
        values = array_of(f"double('{float(tree.leaves.get(n, 0.0))!r}')" for n in range(max(tree.leaves, default=0) + 1))
        state = rows.select("__y", (F.col("__f") + F.coalesce(F.get(values, F.col("node")), F.lit(0.0))).alias("__f"), "__x")
        if checked is not None:
            checked = add(checked)
            error = checked.agg(F.avg(F.abs(inverse_column(spec, "__f") - F.col("__price")))).first()[0]
            model.errors.append(float(error))
            best, left = (error, config.patience) if error < best else (best, left - 1)
            if left <= 0:
                break
        if checked is not None and (k + 1) % TREES_OF_PLAN == 0:
            checked = written(checked, "boost-check")
    if model.errors:
        model.trees = model.trees[: int(np.argmin(model.errors)) + 1]
    model.seconds = time.perf_counter() - start
    return model


def scored(model: Model, bins: Column) -> Column:
    """The sum of the base and all trees' values for a row's bins. Trees are arrays in the tasks: hundreds of them would be too large a plan."""
    routes = [(route := Router(t.splits, model), np.array([t.leaves.get(k, 0.0) for k in range(len(route.place))])) for t in model.trees]
    base = model.base

    @F.arrow_udf("double")
    def total(x: pa.Array) -> pa.Array:
        rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if len(x) else np.zeros((0, 1), dtype=np.int64)
        out = np.full(len(x), base)
        for route, values in routes:
            out += values[route(rows)]
        return pa.array(out)

    return total(bins)


def predict(model: Model, df: DataFrame, name: str = "prediction") -> DataFrame:
    """df with the predicted price, which is 0 at least; null where a residual has no anchor."""
    base = F.lit(model.base)
    out = df.withColumn("__f", scored(model, binned(model, df).cast("array<int>")) if model.trees and model.features() else base + F.lit(sum(t.leaves.get(0, 0.0) for t in model.trees)))
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c != name], inverse_column(model.spec, "__f").alias(name))


def described(tree: Tree, model: Model) -> list[tuple]:
    """(node, feature, threshold, levels, gain, rows, value) of every node: a split's greatest value or the levels that go left (`missing`
    and `other` among them), a leaf's rows and value."""
    out: list[tuple] = []
    for k, s in sorted(tree.splits.items()):
        if s.feature in model.edges:
            out.append((k, s.feature, model.edges[s.feature][s.left[-1] - 1] if s.left[-1] else None, None, s.gain, None, None))
        else:
            out.append((k, s.feature, None, ",".join(sorted({0: "missing", 1: "other"}.get(b) or model.levels[s.feature][b - 2] for b in s.left)), s.gain, None, None))
    return out + [(k, None, None, None, None, tree.rows[k], v) for k, v in sorted(tree.leaves.items())]
