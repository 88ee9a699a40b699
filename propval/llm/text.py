"""Word-level column expressions that several operators share. Words are runs of anything but \\x20 and \\x09-\\x0D."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Array of the words of a text; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def word_hashes(words_: Column) -> Column:
    return F.transform(words_, lambda w: F.xxhash64(w))


def window_hashes(hashes: Column, width: int) -> Column:
    """64-bit hash of each run of `width` words, in order; empty where there are fewer words.

    hashes: a column of `word_hashes` (a column of its own, not an expression: every place reads it)."""
    n = F.size(hashes)
    at = F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for an operator's own columns that no column of df has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"__{name}"
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def unused_prefix(df: DataFrame, name: str) -> str:
    """A prefix for an operator's own columns that begins no column of df, in any case."""
    prefix = f"__{name}_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = f"_{prefix}"
    return prefix


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of df, by name, whatever characters the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
