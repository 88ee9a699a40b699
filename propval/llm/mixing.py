"""Mixing sources to target weights.

The words of each source, its documents in a fixed order, form one stream that is packed into blocks of a fixed
length (the last one may be shorter). A source's target becomes a number of block slots. How many slots of each source
every output shard holds is drawn multinomially (counts of hash draws); the draw is made per source over the shards, so
that the shards' counts of a source add up to its slots exactly and no correction to the targets follows. A shard's slots of a source are
the next ones of that source, by running sums of the counts; slot k takes block perm(k mod blocks) of the pass k div
blocks, perm being a pseudorandom permutation of the source's block indices (swap-or-not rounds: a bijection of any
range, with no table and no sort), and stands in the shard at a place that a second permutation mixes with the other
sources' slots. Slots and blocks then meet in one equi-join on (source, block).

Sources are ranked by code point with null last and weigh 5, 2, 1, repeating. A target never exceeds
`max_passes` times its source's size; the excess is shared by weight among the others until none is above.
What the driver holds is one row per source: the mixture's own configuration, at most `max_sources`.

A null or empty text has size 0 and is never taken. Long texts are as many blocks as they need. Repeated rows (equal id,
source and text) are counted, not gathered: each holds its own words in the stream, and the mixture's rows of them carry the
other columns of any one of them. A null doc_id is a value like any other. There are no ties: documents are ordered by
id, hash of the text and size, and rows equal in these are the same. Other columns stay as they are,
whatever their names. An empty table gives an empty mixture.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from propval.llm.text import n_words, own_columns, words
from propval.session import literal_table, written

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK_WORDS = 64
SHARD_SLOTS = 8192
#: Rows, slots or shards of one source that are handled in one piece.
RUN = 4096
ROUNDS, PLACE_ROUNDS = 24, 8
SEED = 1729


def targets(sizes: list[int], weights: list[float], max_passes: float = 3.0) -> list[float]:
    """Shares of the total size by weight, none above max_passes times its own size."""
    total = float(sum(sizes))
    out, free, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], total
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if unit * weights[i] > max_passes * sizes[i]]
        if not over:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = float(max_passes * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def permuted(x: Column, size: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """x of [0, size) under the swap-or-not permutation that `key` selects."""

    def one(at: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r), size) - at, size)
        top = F.greatest(at, partner)
        return F.when(F.xxhash64(key, r, top, F.lit(1)).bitwiseAND(F.lit(1)) == 1, partner).otherwise(at)

    return F.aggregate(F.array(*[F.lit(r) for r in range(rounds)]), x.cast("long"), one)


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, source, size, tie, copies of every different row; narrow, and written so that texts are read once."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), n_words(text).alias("size"), F.xxhash64(text).alias("tie"))
    return written(rows.groupBy("doc_id", "source", "size", "tie").agg(F.count(F.lit(1)).alias("copies")), "sizes")


def sources_of(sizes: DataFrame, max_passes: float = 3.0, block_words: int = BLOCK_WORDS, max_sources: int = 10_000, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """source, source_no, source_size, docs, target, blocks, slots, shards: one row per source, ranked by code point, null last."""
    rows = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("w"), F.count(F.lit(1)).alias("n")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"a mixture of more than {max_sources} sources: group them first")
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))]
    want = targets([r["w"] for r in rows], weights, max_passes)
    spark = sizes.sparkSession
    plan = []
    for i, (r, t) in enumerate(zip(rows, want, strict=True)):
        blocks = math.ceil(r["w"] / block_words)
        slots = min(round(t * blocks / r["w"]), math.floor(max_passes * blocks)) if r["w"] else 0
        plan.append((r["source"], i, int(r["w"]), int(r["n"]), float(t), int(blocks), int(slots)))
    shards = max(1, -(-sum(p[-1] for p in plan) // shard_slots))
    schema = "source string, source_no int, source_size long, docs long, target double, blocks long, slots long, shards long"
    return literal_table(spark, [(*p, shards) for p in plan], schema)


def placed(sizes: DataFrame, sources: DataFrame, bucket_rows: int = RUN) -> DataFrame:
    """A row for every row of the documents, with its first word's place in its source's stream ('start').

    Two levels, so that no task holds a source: rows fall into hash buckets of about bucket_rows, running
    sums run within a bucket, and bucket totals are summed before them."""
    keyed = sizes.join(F.broadcast(sources.select("source", "source_no", "docs", "source_size", "target")), sizes["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.ceil(F.col("docs") / bucket_rows).cast("long"))).withColumn("all", F.col("size") * F.col("copies"))
    within = W.partitionBy("source_no", "bucket").orderBy("doc_id", "tie", "size").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("source_no").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = keyed.groupBy("source_no", "bucket").agg(F.sum("all").alias("in_bucket"))
    offsets = totals.select("source_no", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("offset"))
    local = keyed.withColumn("inner", F.coalesce(F.sum("all").over(within), F.lit(0))).join(offsets, ["source_no", "bucket"])
    each = local.withColumn("nth", F.explode(F.expr("sequence(1L, copies)")))
    return each.withColumn("start", F.col("offset") + F.col("inner") + (F.col("nth") - 1) * F.col("size")).drop("bucket", "offset", "inner", "docs", "all", "copies")


def shard_counts(sources: DataFrame, seed: int = SEED) -> DataFrame:
    """source_no, shard, n: how many slots of a source each output shard holds, drawn multinomially.

    Draws are made in runs, dealt over the cluster, so that a large source is no large task."""
    firsts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(RUN).cast("long"))).alias("first")
    runs = sources.where("slots > 0").select("source_no", "slots", "shards", firsts).repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source_no", "first")
    draws = runs.select("source_no", "shards", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + RUN, F.col("slots")) - 1)).alias("draw"))
    return draws.groupBy("source_no", F.pmod(F.xxhash64(F.lit(seed), "source_no", "draw"), F.col("shards")).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


def slots(sources: DataFrame, seed: int = SEED) -> DataFrame:
    """shard, position, source_no, slot, pass, block: each place of each shard, and the block that it takes."""
    counts = written(shard_counts(sources, seed), "counts").withColumn("run", F.expr(f"shard div {RUN}"))
    # the slots of a source go to its shards in order: sums over runs of shards, then within a run
    before = W.partitionBy("source_no").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = counts.groupBy("source_no", "run").agg(F.sum("n").alias("all")).select("source_no", "run", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("offset"))
    within = W.partitionBy("source_no", "run").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shard = W.partitionBy("shard")
    placed_ = counts.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0))).join(runs, ["source_no", "run"])
    placed_ = placed_.withColumn("at", F.coalesce(F.sum("n").over(shard.orderBy("source_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("held", F.sum("n").over(shard))
    # few rows grow into many: dealt over the cluster before they do
    placed_ = placed_.join(F.broadcast(sources.select("source_no", "blocks")), "source_no").repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source_no", "shard")
    placed_ = placed_.withColumn("i", F.explode(F.expr("sequence(0L, n - 1)")))
    each = placed_.select("shard", "held", "source_no", "blocks", (F.col("at") + F.col("i")).alias("at"), (F.col("offset") + F.col("inner") + F.col("i")).alias("slot")).withColumn("pass", F.expr("slot div blocks"))
    return each.select(
        "shard",
        permuted(F.col("at"), F.col("held"), F.xxhash64(F.lit(seed + 1), F.col("shard")), PLACE_ROUNDS).alias("position"),
        "source_no",
        "slot",
        "pass",
        permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.xxhash64(F.lit(seed), F.col("source_no"), F.col("pass"))).alias("block"),
    )


def fragments(placed_: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """source_no, block, doc_id, tie, from_word, n_words: the part of each document that each block holds."""
    each = placed_.where("size > 0").select(
        "*", F.explode(F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}"))).alias("block")
    )
    first = F.greatest(F.col("start"), F.col("block") * block_words)
    last = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    return each.select("source_no", "block", "start", (first - F.col("start")).alias("from_word"), (last - first).alias("n_words"))


def mixture(placed_: DataFrame, sources: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """shard, position, source_no, slot, pass, block, start, from_word, n_words: the words that the mixture holds, a run of one row of the documents (source_no, start) each."""
    # a sort-merge join: the few counts that slots grow from would mislead the planner into a broadcast
    return slots(sources, seed=seed).hint("merge").join(fragments(placed_, block_words), ["source_no", "block"])


def taken(docs: DataFrame, **cols: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first_shard (the first one that holds words of it) and tie of every row of docs."""
    sizes = sized(docs, **cols)
    sources = sources_of(sizes)
    rows = placed(sizes, sources)
    # a row's key in the mixture: its place in its source's stream (rows of no words take none)
    used = mixture(rows, sources).groupBy("source_no", "start").agg(F.sum("n_words").alias("taken"), F.min("shard").alias("first_shard"))
    worded = rows.where("size > 0").join(used, ["source_no", "start"], "left")
    empty = rows.where("size = 0").withColumn("taken", F.lit(0).cast("long")).withColumn("first_shard", F.lit(None).cast("long"))
    cols_ = ["doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard", "tie"]
    return worded.select(*cols_).unionByName(empty.select(*cols_))


def packed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """shard, position, source, n_words, text: the mixture's blocks, of block_words words each (a source's last one may hold fewer)."""
    rows = _fragments_of_texts(docs, id_col, source_col, text_col, block_words)
    part = F.struct("start", "n_words", "text")
    blocks = rows.groupBy("shard", "position").agg(F.any_value("source").alias("source"), F.sum("n_words").alias("n_words"), F.sort_array(F.collect_list(part)).alias("parts"))  # at most block_words rows
    return blocks.select("shard", "position", "source", "n_words", F.array_join("parts.text", " ").alias("text"))


def _fragments_of_texts(docs: DataFrame, id_col: str, source_col: str, text_col: str, block_words: int, keep: bool = False) -> DataFrame:
    """shard, position, source, start, n_words, text (words joined by single spaces), and with `keep` the struct `row` of docs' other columns (the text is then the document's own where all of it is taken)."""
    sizes = sized(docs, id_col, source_col, text_col)
    sources = sources_of(sizes, block_words=block_words)
    rows = written(placed(sizes, sources), "placed")
    spans = mixture(rows, sources, block_words).select("source_no", "start", F.struct("shard", "position", "start", "from_word", "n_words").alias("span"))
    of_row = spans.groupBy("source_no", "start").agg(F.collect_list("span").alias("spans"))  # one document's own blocks
    key = F.struct("doc_id", "source", "tie")  # null fields of a struct are equal
    worded = rows.where("size > 0").join(of_row, ["source_no", "start"]).select(key.alias("key"), "size", "spans")
    text = F.col(f"`{text_col}`")
    own = F.struct(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), F.xxhash64(text).alias("tie"))
    others = [c for c, name in zip(own_columns(docs), docs.columns, strict=True) if name.lower() != text_col.lower()]
    columns = [own.alias("key"), text.alias("text"), *([F.struct(*others).alias("row")] if keep else [])]
    texts = docs.where(text.isNotNull()).select(*columns).dropDuplicates(["key"])
    met = texts.join(worded, "key").withColumn("words", words(F.col("text")))
    # exploding within generated code hands on the words themselves, not copies, and what leaves here is cut to the fragment
    each = met.select("key", "size", "text", "words", *(["row"] if keep else []), F.explode("spans").alias("span"))
    part = F.array_join(F.slice("words", (F.col("span.from_word") + 1).cast("int"), F.col("span.n_words").cast("int")), " ")
    cut = F.when(F.col("span.n_words") == F.col("size"), F.col("text")).otherwise(part) if keep else part
    return each.select("span.shard", "span.position", "key.source", "span.start", "span.n_words", cut.alias("text"), *(["row"] if keep else []))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mixture as documents: for each slot, a row with the document's columns for each document that its block holds words of.

    The text is the document's own where all of it is in the block, else the words, in order, joined by spaces. Rows are
    partitioned by shard, and within a shard in the order of its positions. Documents of no words are in no mixture. An
    n_chars column follows the text."""
    rows = _fragments_of_texts(docs, id_col, source_col, text_col, block_words, keep=True)
    rows = rows.repartition("shard").sortWithinPartitions("shard", "position", "start")
    new = {text_col.lower(): F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[(new[c.lower()] if c.lower() in new else F.col("row")[c]).alias(c) for c in docs.columns])
