"""A Merkle manifest of a dataset: leaf digests, one tree a group and one over the groups' roots, and a proof for each row.

Leaves get their places from one global sort: a row's number within its sorted partition, and the rows of its group in the
partitions before, of which there is one count for each group and partition. 2^DEPTH consecutive nodes No group, however large, meets in one task. Going back down, each block hands its nodes the siblings on their way up.

A run is two consecutive nodes, the last one perhaps alone; its digest is of the concatenated hex digests. A lone root stays.
Null fields count as `-`. A null group is a group, before all others. Rows with equal order are placed by their digests, so
that equal rows are interchangeable; a null order comes first. An empty table has no rows and no root. Texts are digested whole.
Only the named columns are read, so extra columns, whatever their names, do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from propval.session import written

#: Levels of a block, which so holds 2^DEPTH nodes.
DEPTH = 10

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """A value as it is digested: `-` for null, else its UTF-8 length, a colon and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def collapsed(nodes: Column, n_levels: Column) -> Column:
    """All levels of a block: its nodes, then n_levels times the digests of the level before's runs of two."""
    above = lambda level: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")), lambda i: F.sha2(F.array_join(F.slice(level, 2 * i + 1, F.lit(2)), ""), 256)
    )
    steps = F.when(n_levels > 0, F.sequence(F.lit(1), n_levels)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(nodes), lambda levels, _: F.concat(levels, F.array(above(F.element_at(levels, -1)))))


def way(levels: Column, at: Column, n_levels: Column) -> Column:
    """What node `at` (from 0) of a block meets on its way up: for each level the sibling (null: none) and whether it stands left."""
    steps = F.when(n_levels > 0, F.sequence(F.lit(0), n_levels - 1)).otherwise(F.array().cast("array<int>"))

    def met(k: Column) -> Column:
        place = F.call_function("shiftright", at, k)
        return F.struct(F.get(F.get(levels, k), place.bitwiseXOR(F.lit(1))).alias("sibling"), (place.bitwiseAND(F.lit(1)) == 1).alias("left"))

    return F.transform(steps, met)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its way up give."""
    return F.aggregate(
        path, leaf, lambda h, s: F.sha2(F.when(s["sibling"].isNull(), h).when(s["left"], F.concat(s["sibling"], h)).otherwise(F.concat(h, s["sibling"])), 256)
    )


def proof(path: Column) -> Column:
    """Digest of the siblings on a way, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: s["sibling"]), ""), 256)


def placed(leaves: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """leaves (the group, `leaf`, the order columns and others) with `place` (from 0) within the group and `n`, the group's leaves."""
    tied = written(leaves.withColumn("tie", F.monotonically_increasing_id()), "leaves")  # equal rows may share a sort key; the number splits them
    ids = F.monotonically_increasing_id()  # the partition in the upper bits, the row below
    ordered = written(tied.orderBy(group, *order, "leaf", "tie").withColumn("at", ids).withColumn("part", F.spark_partition_id()).drop("tie"), "ordered")
    runs = ordered.groupBy(group, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    # one row for each group and partition
    before = W.partitionBy(group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumns({"before": F.coalesce(F.sum("rows").over(before), F.lit(0)), "n": F.sum("rows").over(W.partitionBy(group))})
    runs = runs.select(F.col(group).alias("run_group"), F.col("part").alias("run_part"), "first", "before", "n")
    joined = ordered.join(runs, ordered[group].eqNullSafe(runs["run_group"]) & (ordered["part"] == runs["run_part"]))
    return joined.withColumn("place", F.col("at") - F.col("first") + F.col("before")).drop("run_group", "run_part", "first", "before", "at", "part")


def trees(leaves: DataFrame, group: str, order: Sequence[str] = (), depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """One tree a group: (the leaves with their `path` within it, the groups with their `root`).

    leaves: the group, `leaf` and other columns, which stay."""
    size = 1 << depth
    others = [c for c in leaves.columns if c not in (group, "leaf")]
    nodes = placed(leaves, group, order).select(
        group, "n", "place", F.struct("place", F.col("leaf").alias("h"), F.struct(F.lit(0).alias("none"), *others).alias("of")).alias("node")
    )
    rounds = []
    while True:
        block = F.floor(F.col("place") / size)
        blocks = nodes.groupBy(group, "n", block.alias("block")).agg(F.sort_array(F.collect_list("node")).alias("nodes"))
        # a group of one block ends at its root, however low that is
        last = F.ceil(F.log2(F.col("n").cast("double")) - 1e-9).cast("int")
        blocks = blocks.withColumn("n_levels", F.when(F.col("n") > size, F.lit(depth)).otherwise(F.greatest(last, F.lit(0))))
        blocks = blocks.withColumn("levels", collapsed(F.transform("nodes", lambda x: x["h"]), F.col("n_levels")))
        rounds.append(written(blocks.withColumn("root", F.element_at(F.element_at("levels", -1), 1)), f"blocks{len(rounds)}"))
        # groups of one block are done; the others go on with their blocks' roots
        more = rounds[-1].where(F.col("n") > size)
        if more.isEmpty():
            break
        nodes = more.select(
            group,
            F.ceil(F.col("n") / size).alias("n"),
            F.col("block").alias("place"),
            F.struct(F.col("block").alias("place"), F.col("root").alias("h"), F.struct(F.lit(0).alias("none")).alias("of")).alias("node"),
        )
    # down again: what a block's root meets, then what each of its nodes meets before that
    none = F.array().cast("array<struct<sibling:string,left:boolean>>")
    above = None
    for k, blocks in reversed(list(enumerate(rounds))):
        done = blocks.withColumn("rest", none)
        if above is not None:
            up = above.select(F.col(group).alias("up_group"), F.col("place").alias("up_place"), "path")
            done = blocks.join(up, blocks[group].eqNullSafe(up["up_group"]) & (blocks["block"] == up["up_place"]), "left")
            done = done.withColumn("rest", F.coalesce("path", none)).drop("up_group", "up_place", "path")
        # ways are made before the nodes become rows, so that a block's levels are not copied to each
        ways = F.transform("nodes", lambda x, i: F.struct(x["place"].alias("place"), x["h"].alias("leaf"), x["of"].alias("of"), F.concat(way(F.col("levels"), i, F.col("n_levels")), F.col("rest")).alias("path")))
        found = done.select(group, F.inline(ways))
        above = found if k == 0 else found.drop("leaf", "of")
    tops = None
    for blocks in rounds:
        alone = blocks.where(F.col("n") <= size).select(group, "root")
        tops = alone if tops is None else tops.unionByName(alone)
    return above.select(group, "leaf", *[F.col(f"of.{c}").alias(c) for c in others], "path"), tops


def manifest(docs: DataFrame, group: str = "lang", order: str = "doc_id", fields: Sequence[str] = FIELDS, carried: dict[str, Column] | None = None, depth: int = DEPTH) -> DataFrame:
    """order, leaf, subroot (the group's root), root (over the subroots in order of their groups), path (the leaf's way to the root)
    and the carried columns, which are computed where the rows are read."""
    carried = carried or {}
    leaf = digest(*[field(F.col(c)) for c in fields])
    leaves = docs.select(F.col(group).cast("string").alias("tree"), F.col(order).alias("key"), leaf.alias("leaf"), *[c.alias(f"own_{k}") for k, c in carried.items()])
    within, subroots = trees(leaves, "tree", ["key"], depth)
    named = subroots.select(F.lit(0).alias("all"), F.col("root").alias("leaf"), F.col("tree").alias("name"))
    over, top = trees(named, "all", ["name"], depth)
    groups = over.join(top.withColumnRenamed("root", "top_root"), "all").select("name", F.col("leaf").alias("subroot"), F.col("path").alias("upper"), "top_root")
    found = within.join(groups, within["tree"].eqNullSafe(groups["name"]))
    return found.select(
        F.col("key").alias(order), "leaf", "subroot", F.col("top_root").alias("root"), F.concat("path", "upper").alias("path"), *[F.col(f"own_{k}").alias(k) for k in carried]
    )


def verified(rows: DataFrame, tampered: str = "tampered") -> DataFrame:
    """Adds proof_sha256, folded_root (from the tampered leaf, else the original one) and verified."""
    return rows.withColumns({"proof_sha256": proof(F.col("path")), "folded_root": folded(F.coalesce(F.col(tampered), F.col("leaf")), F.col("path"))}).withColumn(
        "verified", F.col("folded_root") == F.col("root")
    )


def tampered_leaf(seventh: int = 7) -> Column:
    """The leaf of a row with one more character claimed where `seventh` divides crc32 of its id; null elsewhere."""
    more = [(F.col(c) + 1) if c == "n_chars" else F.col(c) for c in FIELDS]
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % seventh == 0, digest(*[field(c) for c in more]))
