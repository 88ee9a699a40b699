"""Exact top-k by inner product: columnar branch and bound.

Candidates are read in blocks and laid out vertically: one row of a block is one dimension over all its candidates. A
query's scores over a block accumulate `STRIDE` dimensions at a time; the mass that the remaining dimensions can still
add is bounded by Cauchy-Schwarz from the norms of what remains, and candidates whose upper bound is below the k-th best
score so far (of all blocks of the task and of a bounded sample of candidates, or, until there are k, the block's k-th best lower bound) are compacted away before
the next step. The survivors' scores are exact: whole numbers in doubles while every sum stays below 2^53, in Python's integers beyond.

Queries go to the candidates, not candidates to queries: batches of at most QUERY_BYTES of queries are sent to all tasks, one
batch after the other, and each task streams its candidates through a batch and returns k rows a query. Candidates are never
shuffled or copied, so for given queries the shuffle grows with the number of tasks alone; a further batch is a further scan.

A component x counts as floor(scale * x). Vectors that are null, or hold a null or non-finite component, take no part; an
empty vector scores 0. Shorter vectors count as padded with zeros; vectors of any length and size are scored in full. Scores
beyond a long are given as its nearest end, and rank by it. Rows without an id that is a whole number take no part. Ties go to
the smaller id. Repeated rows are candidates of their own (the same id may then be returned twice) and one query; a query never
meets rows of its own id. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from propval.session import written

#: Numbers in a block of candidates, queries scored at once, dimensions of a step, bytes of queries sent to a task.
BLOCK_NUMBERS, CHUNK_QUERIES, STRIDE, QUERY_BYTES = 1 << 20, 128, 16, 32 << 20
#: Candidates that are scored first, for a bar to start from.
SEEDS = 1024
SCALE = 256.0
_LONG = 2**63


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (array of double) of the rows that take part."""
    x, i = F.col(f"`{vector_col}`").cast("array<double>"), F.col(f"`{id_col}`").try_cast("long")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(i.isNotNull() & x.isNotNull() & fine).select(i.alias("vec_id"), x.alias("v"))


def matrix(lists: pa.ListArray, dims: int = 0) -> np.ndarray:
    """rows x dims of a column of lists, padded with zeros."""
    lengths = np.asarray(lists.value_lengths(), dtype=np.int64)
    out = np.zeros((len(lengths), max(dims, int(lengths.max(initial=0)))))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.asarray(lists.flatten(), dtype=np.float64)
    return out


def whole(x: np.ndarray, scale: float = SCALE) -> np.ndarray:
    """floor(scale * x): doubles while they are exact to the unit, else Python's integers."""
    if np.abs(x).max(initial=0.0) * scale < 2.0**52:
        return np.floor(x * scale)
    # above 2^52 a double is a whole number
    return np.array([[math.floor(c * scale) if abs(c) < 2.0**52 else int(c) * int(scale) for c in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def tails(x: np.ndarray) -> np.ndarray:
    """steps x rows: the norm of each row from each step's first dimension on."""
    squares = np.cumsum((x**2)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(squares[:, ::STRIDE].T)


class Search:
    """The k best candidates of each query so far."""

    def __init__(self, own: np.ndarray, asks: np.ndarray, k: int, scale: float = SCALE, bars: np.ndarray | None = None) -> None:
        """bars: for each query a score that its k best are known to reach; what is below need not be looked at."""
        self.own, self.asks, self.k, self.scale = own, whole(asks, scale), k, scale
        self.bars = np.full(len(own), -np.inf) if bars is None else bars
        self.best = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))] * len(own)
        self.rest = tails(self.asks) if self.asks.dtype != object and self.asks.shape[1] else None
        #: Products of a component and a component that were computed, and that there were.
        self.done = self.all = 0

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Scores a block: ids, and their vectors as rows."""
        rows = whole(vectors, self.scale)
        dims = min(rows.shape[1], self.asks.shape[1])  # what one side lacks is zero
        rows, asks = rows[:, :dims], self.asks[:, :dims]
        self.all += rows.size * len(asks)
        exact = rows.dtype != object and asks.dtype != object and np.abs(rows).max(initial=0.0) * np.abs(asks).max(initial=0.0) * max(1, dims) < 2.0**53
        if not exact:
            integers = lambda x: x if x.dtype == object else np.array([[int(c) for c in row] for row in x.tolist()], dtype=object).reshape(x.shape)
            rows, asks = integers(rows), integers(asks)
            for q in range(len(asks)):
                self.done += rows.size
                scores = [min(max(sum((a * b for a, b in zip(r, asks[q], strict=True)), 0), -_LONG), _LONG - 1) for r in rows]
                self._keep(q, ids, np.array(scores, dtype=np.int64))
            return
        block = np.ascontiguousarray(rows.T)  # vertical: a row is a dimension
        rest = tails(rows) if dims else None
        for first in range(0, len(asks), CHUNK_QUERIES):
            some = asks[first : first + CHUNK_QUERIES]
            start = some[:, :STRIDE] @ block[:STRIDE]
            self.done += some[:, :STRIDE].size * len(ids)
            for j in range(len(some)):
                self._narrow(first + j, some[j], start[j], block, rest, ids)

    def _narrow(self, q: int, ask: np.ndarray, score: np.ndarray, block: np.ndarray, rest: np.ndarray, ids: np.ndarray) -> None:
        live, dims = np.flatnonzero(ids != self.own[q]), len(ask)
        score = score[live]
        known = self.best[q][1]
        bar = max(self.bars[q], float(known[-1]) if len(known) == self.k else -np.inf)
        for step, at in enumerate(range(STRIDE, dims, STRIDE), 1):
            far = self.rest[step][q] * rest[step][live] * (1 + 1e-9) + 1
            if bar == -np.inf and len(live) > self.k:
                low = np.partition(score - far, len(live) - self.k)[len(live) - self.k]
                keep = score + far >= low
            else:
                keep = score + far >= bar
            if not keep.all():
                live, score = live[keep], score[keep]
            part = block[at : at + STRIDE]
            score = score + ask[at : at + STRIDE] @ (part if len(live) == part.shape[1] else part[:, live])
            self.done += min(STRIDE, dims - at) * len(live)
        fit = score >= bar
        self._keep(q, ids[live][fit], score[fit].astype(np.int64))

    def reached(self) -> np.ndarray:
        """Each query's k-th best score so far, rounded down to a double."""
        return np.array([np.nextafter(float(s[-1]), -np.inf) if len(s) == self.k else -np.inf for _, s in self.best])

    def _keep(self, q: int, ids: np.ndarray, score: np.ndarray) -> None:
        other = ids != self.own[q]  # all, but on the way of integers
        i, s = (np.concatenate(x) for x in zip(self.best[q], (ids[other], score[other]), strict=True))
        if len(i) > 4 * self.k:
            bar = np.partition(s, len(s) - self.k)[len(s) - self.k]
            i, s = i[s >= bar], s[s >= bar]
        order = np.lexsort((i, -s.astype(object) if (s == -_LONG).any() else -s))[: self.k]
        self.best[q] = i[order], s[order]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score. vectors, queries: vec_id, v as `usable` gives them."""
    asked = written(queries.dropDuplicates(["vec_id", "v"]), "queries")
    n, wide = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    batches = max(1, -(-n * (wide + 2) * 8 // QUERY_BYTES))
    schema, parts = "query_id long, vec_id long, score long", []
    # a few candidates, the first by a hash of their ids, tell every task a score that the k best reach: less than QUERY_BYTES
    few = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(SEEDS, QUERY_BYTES // (8 * max(1, wide))))).select("vec_id", F.slice("v", 1, max(1, wide)).alias("v")).toArrow()
    seeds = np.asarray(few["vec_id"], dtype=np.int64), matrix(_list(few["v"]))

    def searched(batch: int) -> DataFrame:
        mine = asked.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(batches)) == batch).toArrow()  # about QUERY_BYTES
        own, asks = np.asarray(mine["vec_id"], dtype=np.int64), matrix(_list(mine["v"]))

        def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first_ = Search(own, asks, k, scale)
            peak = np.abs(seeds[1]).max(initial=0.0) * np.abs(asks).max(initial=0.0) * scale * scale
            if len(seeds[0]) and peak * max(1, asks.shape[1]) < 2.0**52:  # else they would be scored in Python's integers, by every task
                first_.meet(*seeds)
            found = Search(own, asks, k, scale, first_.reached())
            for t in tables:
                lists, at = t.column(1), 0
                sizes = np.cumsum(np.asarray(lists.value_lengths(), dtype=np.int64) + 1)
                while at < t.num_rows:  # blocks of bounded size, at least a row
                    upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK_NUMBERS, side="right")))
                    found.meet(np.asarray(t.column(0).slice(at, upto - at), dtype=np.int64), matrix(lists.slice(at, upto - at)))
                    at = upto
            for first in range(0, len(own), 10_000):
                some = [(own[q], i, s) for q in range(first, min(first + 10_000, len(own))) for i, s in zip(*found.best[q], strict=True)]
                cols = list(zip(*some, strict=True)) if some else [[], [], []]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

        return vectors.select("vec_id", "v").mapInArrow(run, schema)

    for batch in range(batches):
        got = searched(batch)
        parts.append(got if batches == 1 else written(got, "best"))
    met = parts[0]
    for p in parts[1:]:
        met = met.union(p)
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _list(column: pa.ChunkedArray) -> pa.ListArray:
    joined = column.combine_chunks()
    return joined.chunk(0) if isinstance(joined, pa.ChunkedArray) else joined
