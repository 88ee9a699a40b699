"""MinHash near-dedup with DartMinHash signatures.

A text is the set of its five-word shingles (words A-Z lower-cased; a text of one to four words is one shingle), or
the multiset of them (weighting="count"). DartMinHash throws darts into the plane of element weight and rank: each
element owns dyadic regions, and a hash of (element, region) says how many darts fall into it (Poisson of its area)
and where. Darts under the element's weight count; each is hashed to one of K coordinates, and the earliest per
coordinate, by rank, is the signature's value there. About K ln K + 2K darts a text are enough, whatever its length;
texts with an empty coordinate throw further. Two texts agree at a coordinate with probability their (weighted)
Jaccard similarity.

K = 120 values make 24 bands of 5: texts of similarity 0.8 share a band with probability 1 - (1 - 0.8^5)^24 = 0.9999.
Equal texts are one node from the start. In each bucket every text is compared with two pivots; that joins most buckets
into one component each. The buckets that still hold several are cut into blocks of bounded size, and every pair of
blocks that can hold a new link is one job, in which all pairs of texts are counted at once (a matrix product over the
shingles that occur in both). So every pair of a bucket is compared unless a chain of links joins it already: only the bands'
probability decides whether a link is found, at the cost of the square of a bucket of texts that are unlike but collide.
Comparisons are exact (Jaccard of the 64-bit shingle hashes). Classes are the connected components of the links.

Null texts and texts without words are never duplicates. Repeated rows are copies of each other. Null ids are copies like
others (a class's id is its smallest id that is not null). Long texts are read whole; a task holds one text's shingles
beside blocks of BLOCK_ELEMENTS. Ties: of the rows of a class the one with the smallest id stays; of equal rows, one.
Extra columns are not read and stay as they are, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from propval.llm.text import WORD, own_columns, unused
from propval.session import written

SHINGLE, BANDS, ROWS, SIMILARITY = 5, 24, 5, 0.8
K = BANDS * ROWS
DARTS = math.ceil(K * math.log(K) + 2 * K)
#: The smallest region's height in rank; regions double from there.
UNIT = 0.25
#: Elements handled at once, words remembered in a worker.
BLOCK_ELEMENTS, REMEMBERED = 150_000, 200_000
#: Texts, and shingles, of a block of an open bucket; shingles in so few texts of a job are paired one by one.
OPEN_ROWS, OPEN_ELEMENTS, RARE = 1024, 200_000, 16
FOLD = bytes.maketrans(bytes(range(65, 91)) + b"\t\n\x0b\x0c\r", bytes(range(97, 123)) + b"     ")
GOLD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Hashes of all shingles of a text, in order, repeats included."""
    words = (text or "").encode("utf-8", "replace").translate(FOLD).split()
    words = [w for w in words if w]
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(w) - width + 1)
    h = np.full(n, len(w) if len(w) < width else width, dtype=np.uint64)
    for j in range(min(width, len(w))):
        h = mixed(h * GOLD + w[j : j + n])
    return h


def elements(text: str | None, weighting: str = "set") -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted, and their weights."""
    h, n = np.unique(shingles(text), return_counts=True)
    return h, (n.astype(np.float64) if weighting == "count" else np.ones(len(h)))


def members_of(h: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A multiset as a set: one hash for each occurrence."""
    nth = np.arange(int(weights.sum())) - np.repeat(np.cumsum(weights) - weights, weights.astype(np.int64)).astype(np.int64)
    return np.repeat(h, weights.astype(np.int64)) + nth.astype(np.uint64) * GOLD


_CDF: dict[float, np.ndarray] = {}


def _poisson(mean: float) -> np.ndarray:
    if mean not in _CDF:
        p, out = math.exp(-mean), []
        for j in range(int(mean + 12 * math.sqrt(mean) + 20)):
            out.append(p)
            p *= mean / (j + 1)
        _CDF[mean] = np.cumsum(out)
    return _CDF[mean]


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def signatures(elems: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, k: int = K) -> np.ndarray:
    """n x k ranks (as uint64). owner: the row, 0..n-1, of each element; rows without elements keep the largest value."""
    full = np.full(n * k, np.iinfo(np.uint64).max, dtype=np.uint64)
    mass = np.bincount(owner, weights=weights, minlength=n)
    has = mass > 0
    limit = np.where(has, (k * math.log(k) + 2 * k) / np.maximum(mass, 1e-12), 0.0)
    todo = has.copy()
    while todo.any():
        mine = todo[owner]
        e, x, o = elems[mine], weights[mine], owner[mine]
        top, heavy = limit[todo].max(), x.max()
        nu = 0
        while 2.0**nu - 1 < heavy:
            rho = 0
            while (2.0**rho - 1) * UNIT < top:
                low_x, low_r = 2.0**nu - 1, (2.0**rho - 1) * UNIT
                on = (x > low_x) & (limit[o] > low_r)
                if on.any():
                    seed = mixed(e[on] + np.uint64(int(GOLD) * (1 + nu * 64 + rho) % 2**64))
                    count = np.searchsorted(_poisson(2.0 ** (nu + rho) * UNIT), _unit(seed), side="right")
                    at = np.repeat(np.arange(len(seed)), count)
                    if len(at):
                        nth = (np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64)
                        dart = mixed(seed[at] ^ mixed(nth + np.uint64(1)))
                        rank = low_r + _unit(dart) * 2.0**rho * UNIT
                        row = o[on][at]
                        keep = rank < limit[row]
                        if nu or heavy < 1 or (x < 1).any():
                            keep &= low_x + _unit(mixed(dart + np.uint64(1))) * 2.0**nu < x[on][at]
                        dart, rank, row = dart[keep], rank[keep], row[keep]
                        place = mixed(dart + np.uint64(2)) % np.uint64(k)
                        np.minimum.at(full, row * k + place.astype(np.int64), (rank * 2.0**40).astype(np.uint64))
                rho += 1
            nu += 1
        todo = has & (full.reshape(n, k) == np.iinfo(np.uint64).max).any(axis=1)
        limit = np.where(todo, limit * 2, limit)
    return full.reshape(n, k)


def bands_of(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """n x bands hashes; equal only for the same band."""
    out = np.empty((len(sig), bands), dtype=np.uint64)
    for b in range(bands):
        h = np.full(len(sig), b + 1, dtype=np.uint64)
        for r in range(rows):
            h = mixed(h * GOLD + sig[:, b * rows + r])
        out[:, b] = h
    return out.view(np.int64)


def key_of(text: Column) -> Column:
    """What makes texts equal: the MD5, null for texts without words."""
    return F.when(text.rlike(WORD), F.unhex(F.md5(text)))


def signed(docs: DataFrame, id_col: str, text_col: str, weighting: str) -> DataFrame:
    """doc_id, key, size (shingles, with weighting="count" repeats too), bands of every row that has words."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), key_of(F.col(f"`{text_col}`")).alias("key"), F.col(f"`{text_col}`").alias("text")).where("key IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, held, size = 0, [], 0
            for i, text in enumerate(batch.column(2)):
                held.append(elements(text.as_py(), weighting))
                size += len(held[-1][0])
                if size >= BLOCK_ELEMENTS or i + 1 == batch.num_rows:
                    owner = np.repeat(np.arange(len(held)), [len(x[0]) for x in held])
                    sig = signatures(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), owner, len(held))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1, dtype=np.int32) * BANDS), pa.array(bands_of(sig).reshape(-1)))
                    sizes = pa.array(np.array([int(x[1].sum()) for x in held], dtype=np.int64))
                    yield pa.record_batch([batch.column(0).slice(at, len(held)), batch.column(1).slice(at, len(held)), sizes, lists], names=["doc_id", "key", "size", "bands"])
                    at, held, size = i + 1, [], 0
        _WORDS.clear()  # the worker may live on

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key binary, size long, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, weighting: str) -> DataFrame:
    """node, set (hashes, each once; with weighting="count" one for each occurrence). wanted: node, key, doc_id of one row of it."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    w = wanted.withColumnRenamed("doc_id", "w_id")
    found = rows.join(w, rows["doc_id"].eqNullSafe(w["w_id"])).where(key_of(F.col("text")) == F.col("key")).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [members_of(*elements(t.as_py(), weighting)) for t in batch.column(1)]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32))
            flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat.view(np.int64)))], names=["node", "set"])
        _WORDS.clear()

    return found.mapInArrow(run, "node long, set array<long>").dropDuplicates(["node"])


def compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """pairs (a, b) whose similarity reaches the threshold."""
    pick = lambda side: sets.select(F.col("node").alias(side), F.col("set").alias(f"set_{side}"))
    both = pairs.join(pick("b"), "b").join(pick("a"), "a").select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("shared"), (F.size("set_a") + F.size("set_b")).alias("both"))
    return both.where(F.col("shared") / (F.col("both") - F.col("shared")) >= similarity).select("a", "b")


def shared_counts(where: np.ndarray, elems: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many elements each row of `left` shares with each of `right`. elems: of all rows, where: the row of each."""
    at_left, at_right = (np.full(int(where.max(initial=-1)) + 1, -1) for _ in range(2))
    at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
    _, code, count = np.unique(elems, return_inverse=True, return_counts=True)
    out = np.zeros(len(left) * len(right))
    rare = (count[code] > 1) & (count[code] <= RARE)
    order = np.flatnonzero(rare)[np.argsort(code[rare], kind="stable")]
    for step in range(1, RARE):  # neighbours at each distance among the rows of an element
        same = code[order[step:]] == code[order[:-step]]
        if not same.any():
            break
        x, y = where[order[:-step][same]], where[order[step:][same]]
        for p, q in ((x, y), (y, x)):
            fit = (at_left[p] >= 0) & (at_right[q] >= 0)
            out += np.bincount(at_left[p[fit]] * len(right) + at_right[q[fit]], minlength=len(out))
    out = out.reshape(len(left), len(right))
    often = np.flatnonzero(count[code] > RARE)
    column = np.unique(code[often], return_inverse=True)[1]
    for first in range(0, int(column.max(initial=-1)) + 1, 4096):
        some = (column >= first) & (column < first + 4096)
        width = min(4096, int(column.max()) + 1 - first)
        sides = []
        for at, n in ((at_left, len(left)), (at_right, len(right))):
            m, row = np.zeros((n, width), dtype=np.float32), at[where[often[some]]]
            m[row[row >= 0], column[some][row >= 0] - first] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def joined(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> dict[int, int]:
    """Each root that links (rows a, b) join to a smaller one, and the smallest of its chain."""
    up = {int(r): int(r) for r in roots}

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(roots[a], roots[b], strict=True):
        x, y = find(int(x)), find(int(y))
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up if find(x) != x}


def open_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: roots that a link joins in buckets that hold several. members: band, node, root, size of the members still to be compared."""
    several = members.groupBy("band").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("r1 <> r2")
    once = several.groupBy("n", "x", "y").agg(F.min("band").alias("band"))  # buckets of the same members: one of them
    mine = written(members.join(once.select("band"), "band"), "open")
    parts = mine.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("e"))
    # a large component's texts are blocks of their own, which need not meet each other; the small ones share blocks
    large = (F.col("n") >= OPEN_ROWS // 2) | (F.col("e") >= OPEN_ELEMENTS // 2)
    parts = parts.withColumn("g", F.when(large, F.col("root")).otherwise(F.lit(-1).cast("long")))
    blocks = F.greatest(F.ceil(F.sum("n") / OPEN_ROWS), F.ceil(F.sum("e") / OPEN_ELEMENTS)).cast("int")
    groups = written(parts.groupBy("band", "g").agg(blocks.alias("k"), F.sum("n").alias("n")), "groups")
    whole = groups.groupBy("band").agg(F.sum("k").alias("blocks"), F.sum("n").alias("rows")).where("blocks = 1")  # one job each: many of them are one unit
    units = max(1, -(-int(whole.agg(F.sum("rows")).first()[0] or 0) // OPEN_ROWS))
    # pairs of groups first, so that a large component's blocks are not paired with each other
    met = groups.select("band", F.col("g").alias("g0"), F.col("k").alias("k0")).join(groups.select("band", F.col("g").alias("g1"), F.col("k").alias("k1")), "band").where("g0 < g1 OR (g0 = -1 AND g1 = -1)")
    met = met.withColumn("i0", F.explode(F.expr("sequence(0, k0 - 1)"))).withColumn("i1", F.explode(F.expr("sequence(0, k1 - 1)"))).where("g0 < g1 OR i0 <= i1")
    small = met.join(whole.select("band", F.lit(True).alias("whole")), "band", "left")
    jobs = small.withColumn("unit", F.when(F.col("whole"), F.pmod(F.xxhash64("band"), F.lit(units))).otherwise(F.xxhash64("band", "g0", "i0", "g1", "i1"))).withColumn("job", F.xxhash64("band", "g0", "i0", "g1", "i1"))
    ends = jobs.select("band", "unit", "job", F.explode(F.expr("CASE WHEN g0 = g1 AND i0 = i1 THEN array(struct(g0 AS g, i0 AS i, 0 AS side)) ELSE array(struct(g0 AS g, i0 AS i, 0 AS side), struct(g1 AS g, i1 AS i, 1 AS side)) END")).alias("end")).select("band", "unit", "job", "end.*")
    placed = mine.join(parts.select("band", "root", "g"), ["band", "root"]).join(groups.select("band", "g", "k"), ["band", "g"])
    placed = placed.select("band", "g", F.pmod(F.xxhash64("node", F.lit(2)), F.col("k")).cast("int").alias("i"), "node", "root")
    routed = placed.join(ends, ["band", "g", "i"]).join(sets, "node").select("unit", "job", "side", "root", "set")

    def links(t: pa.Table) -> pa.Table:
        job, side, root = (np.asarray(t[c]) for c in ("job", "side", "root"))
        lists = t["set"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        size = np.asarray(lists.value_lengths(), dtype=np.int64)
        flat, ends_ = np.asarray(lists.flatten()), np.cumsum(size)
        found: list[tuple[int, int]] = []
        order = np.argsort(job, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(job[order])) + 1):
            own = size[rows]
            elems = np.concatenate([flat[ends_[r] - size[r] : ends_[r]] for r in rows])
            where = np.repeat(np.arange(len(rows)), own)
            left, right = (np.flatnonzero(side[rows] == x) for x in (0, 1))
            right = right if len(right) else left
            if len(left) and len(right):
                shared = shared_counts(where, elems, left, right)
                a, b = np.nonzero(shared / (own[left][:, None] + own[right][None, :] - shared) >= similarity)
                found.extend(joined(root[rows], left[a], right[b]).items())
        cols = list(zip(*found, strict=True)) if found else [[], []]
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip("ab", cols, strict=True)})

    return routed.groupBy("unit").applyInArrow(links, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root of the connected components of edges (a, b), by alternating large and small stars; hubs are skew joins on written tables."""
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc")
    while True:
        both = e.union(e.select("b", "a")).toDF("u", "v")
        low = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "cc")
        large = written(both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "cc")
        low = written(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "cc")
        moved = large.join(low, large["a"] == low["u"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = written(moved.union(low.select("u", "m").toDF("a", "b")).distinct(), "cc")
        # done when nothing changed
        if not small.exceptAll(e).limit(1).count() and small.count() == e.count():
            return small.select(F.col("a").alias("node"), F.col("b").alias("root"))
        e = small


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weighting: str = "set", similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key of every row with words; key, first (id), class_id, kept, n_texts of every different text)."""
    sig = written(signed(docs, id_col, text_col, weighting), "signatures")
    # nodes are numbered once and written, so that all that follows aggregates and joins by one long
    nodes = written(sig.groupBy("key").agg(F.any_value("bands").alias("bands"), F.min("size").alias("size"), F.min("doc_id").alias("first")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    each = nodes.select("node", "size", F.explode("bands").alias("band"))
    buckets = written(each.groupBy("band").agg(F.min("node").alias("p1"), F.max("node").alias("p2")).where("p1 <> p2"), "buckets")
    members = written(each.join(buckets, "band"), "members")
    tried = members.where("node <> p1").select(F.col("node").alias("a"), F.col("p1").alias("b")).union(members.where("node <> p1 AND node <> p2").select(F.col("p2").alias("a"), F.col("node").alias("b")))
    wanted = members.select("node").distinct().join(nodes.select("node", "key", F.col("first").alias("doc_id")), "node")
    sets = written(shingle_sets(docs, wanted, id_col, text_col, weighting), "sets")
    links = compared(tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), sets, similarity)
    roots = written(nodes.select("node").join(components(links), "node", "left").select("node", F.coalesce("root", "node").alias("root")), "roots")
    untried = members.where("node <> p1 AND node <> p2").select("band", "node", "size").join(roots, "node")
    more = components(open_links(untried, sets, similarity))
    roots = roots.join(more.select(F.col("node").alias("root"), F.col("root").alias("now")), "root", "left").select("node", F.coalesce("now", "root").alias("root"))
    rooted = written(nodes.select("node", "key", "first").join(roots, "node"), "rooted")
    of_root = rooted.groupBy("root").agg(F.min("first").alias("class_id"), F.min_by("node", F.struct(F.col("first").isNull(), "first", "node")).alias("stays"), F.count(F.lit(1)).alias("n_texts"))
    labelled = rooted.join(of_root, "root").select("key", "first", "class_id", (F.col("node") == F.col("stays")).alias("kept"), "n_texts")
    return sig.select("doc_id", "key"), written(labelled, "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: object) -> DataFrame:
    """doc_id, class_id (the smallest id of its class), n_texts (different texts of the class): a row for every row."""
    rows, labelled = classes(docs, id_col, text_col, **how)
    worded = rows.join(labelled, "key").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "n_texts")
    rest = docs.where(key_of(F.col(f"`{text_col}`")).isNull()).select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{id_col}`").alias("class_id"), F.lit(1).cast("long").alias("n_texts"))
    return worded.unionByName(rest)


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: object) -> DataFrame:
    """docs with one row of each class (its smallest id); rows without words all stay."""
    _, labelled = classes(docs, id_col, text_col, **how)
    key, stay, first, nth = unused(docs, "key", "stay", "first", "nth")
    keyed = docs.withColumn(key, key_of(F.col(f"`{text_col}`")))
    one = keyed.join(labelled.where("kept").select(F.col("key").alias(stay), F.col("first").alias(first)), F.col(f"`{id_col}`").eqNullSafe(F.col(first)) & (F.col(key) == F.col(stay)))
    # equal rows of the id that stays: one of them (a group limit precedes the shuffle)
    numbered = one.withColumn(nth, F.row_number().over(W.partitionBy(F.col(f"`{id_col}`"), key).orderBy(F.lit(1))))
    kept = numbered.where(F.col(nth) == 1)
    return kept.select(*own_columns(docs)).unionByName(keyed.where(F.col(key).isNull()).select(*own_columns(docs)))
