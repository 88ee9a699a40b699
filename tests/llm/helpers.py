from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


#: Rows that every operator on documents must take.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 10),
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, " \t\n ", "en", "a", 4),
    (None, "word", "fr", None, 4),
    (5, "é ü 日本 \U0001f600 a b", "fr", "c", 9),
    (6, "x " * 30000, "en", "a", 60000),
    (7, " ".join(f"w{i}" for i in range(20000)), "de", "b", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=ODD, extra: bool = True):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:  # columns that clash with names the operators use
        from pyspark.sql import functions as F

        for c in ("size", "node", "bands", "score", "h", "w", "start", "block", "votes", "n_words", "toxic", "kept"):
            df = df.withColumn(c, F.lit("own"))
        # and with their inner names, in either case
        for c in ("__q_votes", "__Q_failed", "__t_toxic", "__key", "__stay", "__first", "__nth", "__words", "__n", "__tie", "row", "cut", "spans", "shard", "key", "a`b", "c.d"):
            df = df.withColumns({c: F.lit("own")})
    return df
