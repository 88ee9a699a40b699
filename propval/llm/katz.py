"""Bigram language model with Katz backoff, trained and evaluated in partitioned tables.

    P(w | h) = d2(c(h,w)) c(h,w) / c(h)          if (h, w) was seen
             = alpha(h) P(w)                     else, alpha(h) = (1 - sum of the above) / (1 - sum of P over the seen w)
    P(w)     = d1(c(w)) c(w) / N                 if w was seen; what is left is the probability of the one unknown class

d1, d2 are Good-Turing discounts with Katz's cut at CUT (a discount that the counts of counts make no sense of is
(r - 0.5) / r); where nothing is left for the unseen, one is added to the denominator. So every history's
probabilities, unknown class included, sum to 1. A history that was never seen backs off with alpha = 1.

Neither vocabulary nor n-grams fit one machine, and a table row per token would be many times the input. So:

1. The texts become chunks of CHUNK tokens: local word numbers, packed, one row a chunk.
2. Each chunk asks for its distinct words. The unigram table, partitioned by word hash, sums the counts over all
   chunks, numbers the words, and answers every chunk.
3. Each chunk asks for its distinct bigrams. The bigram table, partitioned by history (histories with more than their
   share of tokens by history and word), sums counts and what alpha needs, and answers every chunk. What the shares of a
   divided history sum up to is added by history and joined to the chunks that hold it.
4. Each chunk evaluates its tokens recursively from the answers.

Both tables are stored with their partitions (`Model`): `evaluate` scores new texts from them, by the same requests, and
`tables` shows them as rows of n-gram, count, probability and backoff weight.

A frequent word or bigram is one entry a chunk, so no partition grows with it, and the tables' partitions are as many
as the text needs. The driver holds counts of counts alone.

Words are numbered by a 64-bit hash. Null texts are empty: one end token. Long texts are scored whole, as one row of a chunk. Rows
with null id are training rows; ids may be of any type that has a text, whose crc32 tells the held-out rows. Repeated rows count each; there are no ties. Extra
columns are not read. With no training row every token is unknown, of probability 1. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propval.session import written

CUT, CHUNK, PART_CHARS = 5, 3_000_000, 12_000_000
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: No word holds white space.
BEGIN, END = b"\t", b" "


def pack(x: np.ndarray) -> bytes:
    """Bytes of an array, its byte planes one after the other, compressed."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=3).compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def unpack(b: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


def scattered(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def discounts(n: list[int] | np.ndarray, cut: int = CUT) -> np.ndarray:
    """d[0..cut]: Good-Turing discounts of counts up to cut from n[r], the number of types seen r times (r = 1..cut + 1)."""
    d = np.ones(cut + 1)
    common = (cut + 1) * n[cut + 1] / n[1] if n[1] else 1.0
    for r in range(1, cut + 1):
        good = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        d[r] = good if 0 < good < 1 else (r - 0.5) / r
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * np.where(c < len(d), d[np.minimum(c, len(d) - 1)], 1.0)


class Unigrams:
    """P(w) from counts, and the unknown class."""

    def __init__(self, total: int, types: int, n: list[int]) -> None:
        self.total, self.types, self.d = total, types, discounts(n)
        kept = total - sum((1 - self.d[r]) * r * n[r] for r in range(1, CUT + 1))
        self.base = float(total) if total and kept < total else total + 1.0
        self.unknown = 1.0 - kept / self.base if total else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d) / self.base, self.unknown)


class _Local(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def held_out_of(doc_id: object) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


_CHUNKS = "kind int, part long, chunk long, a binary, b binary, c binary, d binary, e binary"


def chunked(docs: DataFrame, parts: int, chunk: int = CHUNK) -> DataFrame:
    """Rows of kind 0, a chunk's texts, and of kind 1, what it asks of each partition of the unigram table."""

    def rows_of(local: _Local, tokens: list[np.ndarray], ids: list, number: int) -> Iterator[tuple]:
        flat = np.concatenate(tokens)
        lengths = np.array([len(t) for t in tokens], dtype=np.int32)
        train = np.array([not held_out_of(i) for i in ids])
        counts = np.bincount(flat[np.repeat(train, lengths)], minlength=len(local)).astype(np.int64)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, local), dtype=np.uint64, count=len(local))
        part = (hashes % np.uint64(parts)).astype(np.int64)
        rank = np.empty(len(local), dtype=np.int32)
        rank[np.argsort(-np.bincount(flat, minlength=len(local)), kind="stable")] = np.arange(len(local), dtype=np.int32)
        order = np.lexsort((hashes, part))
        yield TEXT, -1, number, pack(rank[flat]), pack(lengths), zstandard.ZstdCompressor(level=3).compress(json.dumps(ids).encode()), pack(train.astype(np.uint8)), pack(np.concatenate([rank[[local[BEGIN]]], rank[order]]))
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        for p in range(parts):
            mine = order[edges[p] : edges[p + 1]]
            if len(mine):
                yield WORDS, p, number, pack(hashes[mine]), pack(counts[mine]), None, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = TaskContext.get().partitionId() << 32
        n, size, local, tokens, ids = 0, 0, _Local(), [], []

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows_of(local, tokens, ids, start + n), strict=True))
            kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["kind", "part", "chunk", "a", "b", "c", "d", "e"])

        local[BEGIN]  # noqa: B018  numbers it
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                words = (text.as_py() or "").encode("utf-8", "replace").translate(LOWER).split()
                words.append(END)
                tokens.append(np.fromiter(map(local.__getitem__, words), dtype=np.int32, count=len(words)))
                ids.append(doc_id.as_py())
                size += len(words)
                if size >= chunk:
                    yield out()
                    n, size, local, tokens, ids = n + 1, 0, _Local(), [], []
                    local[BEGIN]  # noqa: B018
        if ids:
            yield out()

    return docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, _CHUNKS)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    named = [x.strip().split(" ") for x in schema.split(",")]
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in named]
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(named, cols, strict=True)})


#: Kinds of rows: a chunk, requests or answers for words, answers for bigrams, shares of divided histories, the chunks that hold
#: them, and a partition of a table.
TEXT, WORDS, PAIRS, SHARES, HOLDS, TABLE = range(6)
_ANSWER = "kind int, part long, chunk long, a binary, b binary, c binary, d binary, e binary, stats array<long>"


def unigram_answers(asked: DataFrame, parts: int) -> DataFrame:
    """For each partition and chunk: numbers (a) and training counts (b) of the words asked for; once a partition, stats: tokens, types, n_1 .. n_6."""

    def run(t: pa.Table) -> pa.Table:
        part, chunks = t["part"][0].as_py(), t["chunk"].to_pylist()
        hashes = [unpack(x.as_py(), np.uint64) for x in t["a"]]
        counts = np.concatenate([unpack(x.as_py(), np.int64) for x in t["b"]])
        found, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.zeros(len(found), dtype=np.int64)
        np.add.at(total, inverse, counts)
        n = np.bincount(total[(total > 0) & (total <= CUT + 1)], minlength=CUT + 2)[1:]
        stats, rows = [int(total.sum()), int((total > 0).sum()), *map(int, n)], []
        for k, piece in enumerate(np.split(inverse, np.cumsum([len(h) for h in hashes])[:-1])):
            rows.append((WORDS, part, chunks[k], pack(piece.astype(np.int64) * parts + part), pack(total[piece]), None, None, None, None if k else stats))
        rows.append((TABLE, part, -1, pack(found), pack(total), None, None, None, None))
        return _table(rows, _ANSWER)

    return asked.groupBy("part").applyInArrow(run, _ANSWER)


class _Chunk:
    """A chunk with the unigram table's answers: its bigrams, distinct and in the order of the requests."""

    def __init__(self, own: pa.Table, answers: pa.Table, parts: int, heavy: float, begins: int) -> None:
        row = {k: own[k][0].as_py() for k in ("chunk", "a", "b", "c", "d", "e")}
        self.number = row["chunk"]
        self.tokens, self.lengths = unpack(row["a"], np.int32), unpack(row["b"], np.int32)
        self.ids = json.loads(zstandard.ZstdDecompressor().decompress(row["c"]))
        self.train = unpack(row["d"], np.uint8).astype(bool)
        places = unpack(row["e"], np.int32)
        begin, places = int(places[0]), places[1:]
        mine = sorted(((r["part"], r["a"], r["b"]) for r in answers.select(["kind", "part", "a", "b"]).to_pylist() if r["kind"] == WORDS), key=lambda r: r[0])
        self.number_of, self.count = np.empty(len(places), dtype=np.int64), np.empty(len(places), dtype=np.int64)
        self.number_of[places] = np.concatenate([unpack(r[1], np.int64) for r in mine])
        self.count[places] = np.concatenate([unpack(r[2], np.int64) for r in mine])
        ends = np.cumsum(self.lengths, dtype=np.int64)
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[ends - self.lengths] = begin
        wide = np.int64(len(places))
        pairs, self.pair_of = np.unique(before * wide + self.tokens, return_inverse=True)
        self.h, self.w = (pairs // wide).astype(np.int64), (pairs % wide).astype(np.int64)
        history = self.count.copy()
        history[begin] = begins
        self.hot = history > heavy
        gh, gw = self.number_of[self.h], self.number_of[self.w]
        self.part = (np.where(self.hot[self.h], scattered(gh * np.int64(1_000_003) + gw), scattered(gh)) % np.uint64(parts)).astype(np.int64)
        self.order = np.lexsort((gw, gh, self.part))
        self.edges = np.searchsorted(self.part[self.order], np.arange(parts + 1))
        self.parts = parts

    def asks(self) -> Iterator[tuple]:
        counts = np.bincount(self.pair_of[np.repeat(self.train, self.lengths)], minlength=len(self.h)).astype(np.int64)
        for p in range(self.parts):
            x = self.order[self.edges[p] : self.edges[p + 1]]
            if len(x):
                h, first = self.number_of[self.h[x]], np.flatnonzero(np.diff(self.h[x], prepend=-1))
                hot = self.hot[self.h[x[first]]].astype(np.uint8)
                runs = np.diff(np.append(first, len(x))).astype(np.int32)
                yield p, self.number, pack(np.diff(h[first], prepend=0)), pack(runs), pack(self.number_of[self.w[x]]), pack(counts[x]), pack(self.count[self.w[x]]), pack(hot)

    def scores(self, answers: pa.Table, uni: Unigrams, d2: np.ndarray) -> tuple[np.ndarray, ...]:
        c = np.zeros(len(self.h), dtype=np.int64)
        of = np.zeros((len(self.number_of), 2 + CUT))
        hot: dict[int, list[float]] = {}
        for r in answers.to_pylist():
            if r["kind"] == SHARES:
                hot[r["part"]] = [*r["few"], r["seen"]]
            if r["kind"] != PAIRS:
                continue
            x = self.order[self.edges[r["part"]] : self.edges[r["part"] + 1]]
            c[x] = unpack(r["a"], np.int64)
            first = self.h[x[np.flatnonzero(np.diff(self.h[x], prepend=-1))]]
            few = unpack(r["c"], np.int64).reshape(CUT + 1, -1)
            of[first, : CUT + 1] = few.T
            of[first, CUT + 1] = unpack(r["b"], np.float64)
        for j in np.flatnonzero(self.hot):
            if (s := hot.get(int(self.number_of[j]))) is not None:
                of[j] = s
        total, few, seen = of[:, 0], of[:, 1 : CUT + 1], of[:, CUT + 1]
        lost = few @ ((1 - d2[1:]) * np.arange(1, CUT + 1))
        base = np.where(lost > 0, total, total + 1)
        left = np.where(lost > 0, lost, 1.0) / np.maximum(base, 1)
        alpha = np.where(total > 0, left / np.maximum(1 - seen, 1e-300), 1.0)
        p_w = uni.p(self.count)
        p = np.where(c > 0, discounted(c, d2) / np.maximum(base, 1)[self.h], alpha[self.h] * p_w[self.w])
        log = np.log10(p)[self.pair_of]
        plain = np.log10((self.count + 0.5) / (uni.total + 0.5 * (uni.types + 1)))[self.tokens]
        doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        n = len(self.lengths)
        return np.bincount(doc, weights=log, minlength=n), np.bincount(doc, weights=plain, minlength=n), np.bincount(doc, weights=self.count[self.tokens] > 0, minlength=n).astype(np.int64)


_ASK = "part long, chunk long, h binary, runs binary, w binary, n binary, cw binary, hot binary"


def bigram_answers(asked: DataFrame, uni: Unigrams) -> DataFrame:
    """For each partition and chunk: counts (a) of the bigrams asked for, and of their histories total, number of words
    seen 1..CUT times (c) and the sum of P(w) over the seen (b); once a partition, stats: n_1 .. n_6, its share of the
    histories that are divided (numbers d, then as above), which chunks hold them, and the partition of the table itself."""

    def run(t: pa.Table) -> pa.Table:
        part, chunks = t["part"][0].as_py(), t["chunk"].to_pylist()
        firsts = [np.cumsum(unpack(x.as_py(), np.int64)) for x in t["h"]]
        runs = [unpack(x.as_py(), np.int32) for x in t["runs"]]
        sizes = [int(r.sum()) for r in runs]
        gh = np.concatenate([np.repeat(f, r) for f, r in zip(firsts, runs, strict=True)])
        gw = np.concatenate([unpack(x.as_py(), np.int64) for x in t["w"]])
        n = np.concatenate([unpack(x.as_py(), np.int64) for x in t["n"]])
        cw = np.concatenate([unpack(x.as_py(), np.int64) for x in t["cw"]])
        hot = np.unique(np.concatenate([f[unpack(x.as_py(), np.uint8) > 0] for f, x in zip(firsts, t["hot"], strict=True)]))
        hs, h = np.unique(gh, return_inverse=True)
        ws, w = np.unique(gw, return_inverse=True)
        found, at, inverse = np.unique(h * np.int64(len(ws)) + w, return_index=True, return_inverse=True)
        c = np.zeros(len(found), dtype=np.int64)
        np.add.at(c, inverse, n)
        on = c > 0
        few = np.zeros((CUT + 1, len(hs)), dtype=np.int64)
        few[0] = np.bincount(h[at][on], weights=c[on], minlength=len(hs)).astype(np.int64)
        for r in range(1, CUT + 1):
            few[r] = np.bincount(h[at][c == r], minlength=len(hs))
        seen = np.bincount(h[at][on], weights=uni.p(cw[at][on]), minlength=len(hs))
        stats, rows = [int((c == r).sum()) for r in range(1, CUT + 2)], []
        for k, (piece, f) in enumerate(zip(np.split(inverse, np.cumsum(sizes)[:-1]), firsts, strict=True)):
            j = np.searchsorted(hs, f)
            rows.append((PAIRS, part, chunks[k], pack(c[piece]), pack(seen[j]), pack(few[:, j].reshape(-1)), None, None, None if k else stats))
            if len(own := f[unpack(t["hot"][k].as_py(), np.uint8) > 0]):
                rows.append((HOLDS, part, chunks[k], None, None, None, pack(own), None, None))
        if len(hot):
            j = np.searchsorted(hs, hot)
            rows.append((SHARES, part, -1, None, pack(seen[j]), pack(few[:, j].reshape(-1)), pack(hot), None, None))
        keep = np.flatnonzero(on)  # in order of history, then word
        kept, first = np.unique(h[at][keep], return_index=True)
        sums = np.concatenate([few[:, kept].reshape(-1).astype(np.float64), seen[kept]])
        rows.append((TABLE, part, -1, pack(np.diff(hs[kept], prepend=0)), pack(np.diff(np.append(first, len(keep))).astype(np.int32)), pack(gw[at][keep]), pack(c[keep]), pack(sums), None))
        return _table(rows, _ANSWER)

    return asked.groupBy("part").applyInArrow(run, _ANSWER)


def _opened(row: dict) -> tuple[np.ndarray, ...]:
    """A partition of the bigram table: history and word of each bigram, its count; each history, and its total, numbers of
    words seen 1..CUT times and P of the seen (rows)."""
    hs, runs = np.cumsum(unpack(row["a"], np.int64)), unpack(row["b"], np.int32)
    return np.repeat(hs, runs), unpack(row["c"], np.int64), unpack(row["d"], np.int64), hs, unpack(row["e"], np.float64).reshape(CUT + 2, -1)


def _of_divided(answers: DataFrame, shares: DataFrame) -> DataFrame:
    """kind SHARES, part: the history, chunk, few, seen: what each chunk needs of the divided histories it holds. shares: number, few, seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [unpack(x.as_py(), np.int64) for x in b.column(1)]
            yield pa.record_batch([pa.array(np.repeat(np.asarray(b.column(0), dtype=np.int64), [len(x) for x in held])), pa.array(np.concatenate(held) if held else np.zeros(0, dtype=np.int64))], names=["chunk", "number"])

    holds = answers.where(F.col("kind") == HOLDS).select("chunk", "d").mapInArrow(run, "chunk long, number long").distinct()
    return holds.join(shares, "number").select(F.lit(SHARES).alias("kind"), F.col("number").alias("part"), "chunk", "few", "seen")


def _shares(pairs: DataFrame) -> DataFrame:
    """number, few (total, then words seen 1..CUT times), seen of every divided history, over all its shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for seen, few, number in zip(*(b.column(k) for k in range(3)), strict=True):
                number = unpack(number.as_py(), np.int64)
                few = unpack(few.as_py(), np.int64).reshape(CUT + 1, -1)
                yield pa.record_batch([pa.array(number), *[pa.array(x) for x in few], pa.array(unpack(seen.as_py(), np.float64))], names=["number", *[f"f{r}" for r in range(CUT + 1)], "seen"])

    each = pairs.where(F.col("kind") == SHARES).select("b", "c", "d").mapInArrow(run, "number long, " + ", ".join(f"f{r} long" for r in range(CUT + 1)) + ", seen double")
    sums = each.groupBy("number").agg(*[F.sum(f"f{r}").alias(f"f{r}") for r in range(CUT + 1)], F.sum("seen").alias("seen"))
    return sums.select("number", F.array(*[f"f{r}" for r in range(CUT + 1)]).alias("few"), "seen")


def _sums(answers: DataFrame, n: int) -> list[int]:
    row = answers.where("stats IS NOT NULL").agg(*[F.sum(F.col("stats")[k]).alias(f"s{k}") for k in range(n)]).first()
    return [int(x or 0) for x in row]


@dataclass
class Model:
    """The stored tables, and what reads them: partitions, the count that divides a history, the number of texts learned from."""

    unigrams: DataFrame
    bigrams: DataFrame
    shares: DataFrame
    parts: int
    heavy: float
    begins: int
    uni: Unigrams
    d2: np.ndarray


#: Ids travel as text, whatever their type.
_SCORES = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _evaluated(texts: DataFrame, words: DataFrame, pairs: DataFrame, m: Model) -> DataFrame:
    """The scores of the texts of chunks, from the answers of both tables."""
    parts, heavy, begins, uni, d2 = m.parts, m.heavy, m.begins, m.uni, m.d2  # not the tables: they stay out of the closure

    def evaluate(own: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(own):
            return _table([], _SCORES)
        x = _Chunk(own, answers, parts, heavy, begins)
        score, base, known = x.scores(answers, uni, d2)
        ids = pa.array(x.ids, pa.string())
        n = len(x.ids)
        return pa.table([ids, pa.array(~x.train), pa.array(x.lengths.astype(np.int64)), pa.array(known), pa.array(np.full(n, uni.total, dtype=np.int64)), pa.array(base), pa.array(score)], names=[f.split(" ")[0] for f in _SCORES.split(", ")])

    none = [F.lit(None).cast("array<long>").alias("few"), F.lit(None).cast("double").alias("seen")]
    own = ["kind", "part", "chunk", "a", "b", "c"]
    answers = words.where(F.col("kind") == WORDS).select(*own, *none).unionByName(pairs.where(F.col("kind") == PAIRS).select(*own, *none))
    answers = answers.unionByName(_of_divided(pairs, m.shares), allowMissingColumns=True)
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(evaluate, _SCORES)


def _asked(texts: DataFrame, words: DataFrame, parts: int, heavy: float, begins: int) -> DataFrame:
    def ask(own: pa.Table, answers: pa.Table) -> pa.Table:
        return _table(list(_Chunk(own, answers, parts, heavy, begins).asks()) if len(own) else [], _ASK)

    answers = words.where(F.col("kind") == WORDS).select("kind", "part", "chunk", "a", "b")
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(ask, _ASK)


def _typed(scores: DataFrame, docs: DataFrame) -> DataFrame:
    """Ids as docs has them."""
    return scores.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def learned(docs: DataFrame, chunk: int = CHUNK, part_chars: int = PART_CHARS) -> tuple[Model, DataFrame]:
    """The model of the training rows of docs (doc_id, text), and the scores of all its rows from the same two passes."""
    rows_ = docs.select("doc_id", "text")
    size = rows_.agg(F.sum(F.length("text")).alias("n"), F.count_if(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1, F.lit(True))).alias("begins")).first()
    parts, begins = max(1, -(-int(size["n"] or 0) // part_chars)), int(size["begins"] or 0)
    rows = written(chunked(rows_, parts, chunk), "chunks")
    texts = rows.where(F.col("kind") == TEXT)
    words = written(unigram_answers(rows.where(F.col("kind") == WORDS).select("part", "chunk", "a", "b"), parts), "unigrams")
    total, types, *n1 = _sums(words, 2 + CUT + 1)
    uni = Unigrams(total, types, [0, *n1])
    heavy = max(1.0, total / (4 * parts))
    pairs = written(bigram_answers(_asked(texts, words, parts, heavy, begins), uni), "bigrams")
    d2 = discounts([0, *_sums(pairs, CUT + 1)])
    stored = lambda t: t.where(F.col("kind") == TABLE).drop("kind", "chunk", "stats")
    model = Model(stored(words), stored(pairs), written(_shares(pairs), "shares"), parts, heavy, begins, uni, d2)
    return model, _typed(_evaluated(texts, words, pairs, model), docs)


def scored(docs: DataFrame, chunk: int = CHUNK, part_chars: int = PART_CHARS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row (doc_id, text); log10 probabilities."""
    return learned(docs, chunk, part_chars)[1]


def evaluate(docs: DataFrame, model: Model, chunk: int = CHUNK) -> DataFrame:
    """The scores of new texts (doc_id, text) by a learned model's stored tables; columns as `scored` gives them."""
    rows = written(chunked(docs, model.parts, chunk), "chunks")
    texts, parts = rows.where(F.col("kind") == TEXT), model.parts

    def words_of(asked: pa.Table, table: pa.Table) -> pa.Table:
        if not len(asked):
            return _table([], _ANSWER)
        part = asked["part"][0].as_py()
        found, total = (unpack(table["a"][0].as_py(), np.uint64), unpack(table["b"][0].as_py(), np.int64)) if len(table) else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
        out = []
        for chunk_, a in zip(asked["chunk"].to_pylist(), asked["a"], strict=True):
            h = unpack(a.as_py(), np.uint64)
            at = np.minimum(np.searchsorted(found, h), max(0, len(found) - 1))
            known = (found[at] == h) if len(found) else np.zeros(len(h), dtype=bool)
            number = np.where(known, at, len(found) + np.arange(len(h)))  # new words are after all that the table knows
            out.append((WORDS, part, chunk_, pack(number * parts + part), pack(np.where(known, total[at] if len(total) else 0, 0).astype(np.int64)), None, None, None, None))
        return _table(out, _ANSWER)

    words = written(rows.where(F.col("kind") == WORDS).select("part", "chunk", "a").groupBy("part").cogroup(model.unigrams.groupBy("part")).applyInArrow(words_of, _ANSWER), "answers")

    def pairs_of(asked: pa.Table, table: pa.Table) -> pa.Table:
        if not len(asked):
            return _table([], _ANSWER)
        part = asked["part"][0].as_py()
        empty = np.zeros(0, dtype=np.int64)
        th, tw, tc, hs, sums = _opened(table.to_pylist()[0]) if len(table) else (empty, empty, empty, empty, np.zeros((CUT + 2, 0)))
        order, out = np.lexsort((tw, th)), []
        th, tw, tc = th[order], tw[order], tc[order]
        for r in asked.to_pylist():
            f = np.cumsum(unpack(r["h"], np.int64))
            h, w = np.repeat(f, unpack(r["runs"], np.int32)), unpack(r["w"], np.int64)
            # one search in the pairs of both: a bigram of the table comes before its equal of the request
            both = np.lexsort((np.repeat([0, 1], [len(th), len(h)]), np.concatenate([tw, w]), np.concatenate([th, h])))
            last = np.maximum.accumulate(np.where(both < len(th), both, -1))
            mine = both >= len(th)
            to, at = both[mine] - len(th), last[mine]
            c = np.zeros(len(h), dtype=np.int64)
            hit = (at >= 0) & (th[at] == h[to]) & (tw[at] == w[to]) if len(th) else np.zeros(len(to), dtype=bool)
            c[to[hit]] = tc[at[hit]]
            j = np.minimum(np.searchsorted(hs, f), max(0, len(hs) - 1))
            got = np.where(hs[j] == f, sums[:, j], 0.0) if len(hs) else np.zeros((CUT + 2, len(f)))
            out.append((PAIRS, part, r["chunk"], pack(c), pack(got[CUT + 1]), pack(got[: CUT + 1].astype(np.int64).reshape(-1)), None, None, None))
            if len(own := f[unpack(r["hot"], np.uint8) > 0]):
                out.append((HOLDS, part, r["chunk"], None, None, None, pack(own), None, None))
        return _table(out, _ANSWER)

    asked = _asked(texts, words, parts, model.heavy, model.begins)
    pairs = written(asked.groupBy("part").cogroup(model.bigrams.groupBy("part")).applyInArrow(pairs_of, _ANSWER), "answers")
    return _typed(_evaluated(texts, words, pairs, model), docs)


def tables(model: Model) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stored tables as rows: (word, count, p) of the words seen in training, (history, word, count, p) of the bigrams, (history, total, backoff)
    of the histories. Words are numbers here, but for the first table's `hash`, by which a word is found."""
    parts, uni, d2 = model.parts, model.uni, model.d2

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, a, n in zip(*(b.column(k) for k in range(3)), strict=True):
                found, total = unpack(a.as_py(), np.uint64), unpack(n.as_py(), np.int64)
                yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(np.arange(len(found)) * parts + part.as_py()), pa.array(total), pa.array(uni.p(total))], names=["hash", "word", "count", "p"])

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                h, w, c, _, _ = _opened(row)
                yield pa.record_batch([pa.array(h), pa.array(w), pa.array(c)], names=["history", "word", "count"])

    def histories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                *_, hs, sums = _opened(row)
                lost = sums[1 : CUT + 1].T @ ((1 - d2[1:]) * np.arange(1, CUT + 1))
                yield pa.record_batch([pa.array(hs), pa.array(sums[0].astype(np.int64)), pa.array(lost), pa.array(sums[CUT + 1])], names=["history", "total", "lost", "seen"])

    first = model.unigrams.select("part", "a", "b").mapInArrow(words, "hash long, word long, count long, p double").where("count > 0")
    sums = model.bigrams.select("a", "b", "c", "d", "e").mapInArrow(histories, "history long, total long, lost double, seen double").groupBy("history").agg(F.sum("total").alias("total"), F.sum("lost").alias("lost"), F.sum("seen").alias("seen"))
    base = F.when(F.col("lost") > 0, F.col("total")).otherwise(F.col("total") + 1)
    held = F.when(F.col("lost") > 0, F.col("lost")).otherwise(1.0)
    weights = sums.select("history", "total", base.alias("base"), (held / base / F.greatest(1.0 - F.col("seen"), F.lit(1e-300))).alias("backoff"))
    counted = model.bigrams.select("a", "b", "c", "d", "e").mapInArrow(bigrams, "history long, word long, count long")
    discount = F.coalesce(F.get(F.array(*[F.lit(float(x)) for x in d2]), F.col("count").cast("int")), F.lit(1.0))
    second = counted.join(weights, "history").select("history", "word", "count", (F.col("count") * discount / F.col("base")).alias("p"))
    return first, second, weights.drop("base")
