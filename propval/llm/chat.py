"""Chat formatting over reply trees.

Messages name their parent. Root-to-leaf paths come from self-joins that double in length: after round k every
message knows its ancestor 2^k steps up and the score on the way, so a tree of depth d takes log2(d) rounds.
Branches (leaves) of a conversation are ranked by mean score, ties to the longer branch, then to the smaller leaf
key; the chosen ones alone are expanded to their messages, by the same jumps, and each becomes one conversation.
A table of plain turns is the case where each row replies to the one before.

The template marks a turn as <|im_start|>role\\ntext<|im_end|>\\n. Control strings inside texts (also those of
other common templates) get a backslash after their first character, a backslash itself is doubled, and roles are
URL-encoded; all of it is undone by `turns_of`. The loss mask is a list of (start, length) in code points over the
formatted string, one entry for each assistant text.

Null texts and null roles are empty. Rows with equal turn are ordered by role, then text; repeated rows each count.
Rows with null conv_id form one conversation. A message whose parent is missing is a root; messages on a cycle of
parents reach no root and are left out. Long texts are formatted whole, and a conversation of any length is one row. Ties between
branches: see above. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from propval.session import written

START, END = "<|im_start|>", "<|im_end|>\n"
#: What is broken up inside texts: the first character, then the rest.
CONTROL = r"(<)(\|[A-Za-z0-9_]*\||/?s>|(?:start|end)_of_turn>|[be]os>)|(\[)(/?INST\])|(<)(</?SYS>>)"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1$3$5\\$2$4$6")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def as_replies(turns: DataFrame) -> DataFrame:
    """conv_id, id, parent, role, text, score of a table of plain turns: each row replies to the one before."""
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    keyed = turns.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("id"))
    return keyed.select("conv_id", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _pairs(left: DataFrame, right: DataFrame, up: str, how: str = "left") -> DataFrame:
    on = left["conv_id"].eqNullSafe(right["r_conv"]) & (left[up] == right["r_id"])
    return left.join(right, on, how)


def jumps(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(conv_id, id, steps, score up to and with the root, of every message that reaches one; tables k = 0, 1, ... of
    conv_id, id, up: the ancestor 2^k steps up). A message takes part in a round only while it has such an ancestor."""
    cols = ["conv_id", "id", "up", "steps", "score"]
    ids = messages.select(F.col("conv_id").alias("r_conv"), F.col("id").alias("r_id"))
    known = _pairs(messages.select("conv_id", "id", "parent", "score"), ids, "parent")
    now = written(known.select("conv_id", "id", F.col("r_id").alias("up"), F.lit(1).cast("long").alias("steps"), F.coalesce("score", F.lit(0.0)).alias("score")), "jump")
    left, out, most = now.where("up IS NOT NULL"), [], now.count()
    done = now.where("up IS NULL")
    while 1 << len(out) <= most and not left.isEmpty():  # what is left then stands on a cycle
        out.append(left)
        far = left.unionByName(done).select(F.col("conv_id").alias("r_conv"), F.col("id").alias("r_id"), F.col("up").alias("r_up"), F.col("steps").alias("r_steps"), F.col("score").alias("r_score"))
        now = written(_pairs(left, far, "up", "inner").select("conv_id", "id", F.col("r_up").alias("up"), (F.col("steps") + F.col("r_steps")).alias("steps"), (F.col("score") + F.col("r_score")).alias("score")), "jump")
        left, done = now.where("up IS NOT NULL"), done.unionByName(now.where("up IS NULL").select(*cols))
    return done.drop("up"), out


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """conv_id, leaf, branch, back, id: the messages of the `branches` best branches of each conversation ('back' from the leaf, 0)."""
    top, tables = jumps(messages)
    parents = messages.where("parent IS NOT NULL").select(F.col("conv_id").alias("r_conv"), F.col("parent").alias("r_id")).distinct()
    leaves = top.join(parents, top["conv_id"].eqNullSafe(parents["r_conv"]) & (top["id"] == parents["r_id"]), "left_anti")
    rank = W.partitionBy("conv_id").orderBy((F.col("score") / F.col("steps")).desc(), F.col("steps").desc(), "id")
    best = leaves.withColumn("branch", F.row_number().over(rank)).where(F.col("branch") <= branches)
    found = best.select("conv_id", F.col("id").alias("leaf"), "branch", F.lit(0).cast("long").alias("back"), "id")
    for k, t in enumerate(tables):  # the messages nearer than 2^k to their leaf give those at 2^k and more
        far = t.select(F.col("conv_id").alias("r_conv"), F.col("id").alias("r_id"), F.col("up"))
        found = written(found.unionByName(_pairs(found, far, "id", "inner").select("conv_id", "leaf", "branch", (F.col("back") + (1 << k)).alias("back"), F.col("up").alias("id"))), "paths")
    return found


def formatted(messages: DataFrame, branches: int = 1, learn: str = "assistant") -> DataFrame:
    """conv_id, branch, leaf, n_turns, formatted, loss (array of start, length): a row for each chosen path."""
    chosen = paths(messages, branches)
    said = messages.select(F.col("conv_id").alias("r_conv"), F.col("id").alias("r_id"), "role", "text")
    turn = F.struct(
        (-F.col("back")).alias("at"),
        F.concat(F.lit(START), F.url_encode(F.coalesce("role", F.lit(""))), F.lit("\n")).alias("head"),
        escaped(F.col("text")).alias("body"),
        (F.coalesce(F.col("role"), F.lit("")) == learn).alias("learn"),
    )
    rows = _pairs(chosen, said, "id", "inner").groupBy("conv_id", "branch", "leaf").agg(F.sort_array(F.collect_list(turn)).alias("turns"))  # one output row's own turns
    whole = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END)))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"))

    def add(a: Column, t: Column) -> Column:
        head, body = F.length(t["head"]).cast("long"), F.length(t["body"]).cast("long")
        span = F.struct((a["at"] + head).alias("start"), body.alias("length"))
        return F.struct((a["at"] + head + body + len(END)).alias("at"), F.when(t["learn"], F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    return rows.select("conv_id", "branch", "leaf", F.size("turns").cast("long").alias("n_turns"), F.concat_ws("", whole).alias("formatted"), F.aggregate("turns", start, add)["spans"].alias("loss"))


def turns_of(text: Column) -> Column:
    """array of (role, text), read back from a formatted string."""
    parts = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda x: x != "")

    def one(p: Column) -> Column:
        cut = F.locate("\n", p)
        return F.struct(
            F.url_decode(F.substring(p, F.lit(len(START) + 1), cut - (len(START) + 1))).alias("role"),
            unescaped(F.substring(p, cut + 1, F.length(p))).alias("text"),
        )

    return F.transform(parts, one)


def learned_text(text: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, read back from the formatted string."""
    return F.concat_ws("", F.transform(loss, lambda s: unescaped(F.substring(text, (s["start"] + 1).cast("int"), s["length"].cast("int")))))
