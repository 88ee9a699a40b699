"""License scans: which licence notices stand in which texts.

A text is lower-cased, punctuation becomes space, and its five-word shingles are hashed. Overlapping windows of
WINDOW shingles, a step of STEP apart, are MinHashed with BANDS independent functions, one row a band. Every
template is indexed by its pieces: all runs of PIECE shingles (the whole template if shorter). Any run of PIECE
shingles of a notice lies whole in some window, so window and piece have Jaccard similarity PIECE / WINDOW = 3/4
and meet with probability 1 - (1/4)^32; a notice of a single shingle still has 1/4, hence 1 - (3/4)^32 = 0.9999.
A retrieved template is then verified exactly: the share of its shingles that stand in the text around the window
must reach `containment`.

A window can only meet a piece in a band if it holds the piece's smallest shingle of that band. Texts and windows
without any such shingle are left out before MinHashing; this loses nothing.

Templates of fewer than five words are one shingle of their own length, and texts are shingled by that length for them; a
template without words is an error.

The templates are a parameter (name -> text), small enough for the driver. Null and empty texts, and texts shorter than every
template's shingle, match nothing. Long texts are read whole. Repeated rows give repeated results, as do several licences that share
a wording: there are no ties to break. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propval.llm.text import window_hashes, word_hashes, words
from propval.session import literal_table

SHINGLE, WINDOW, STEP, PIECE, BANDS, CONTAINMENT = 5, 4, 2, 3, 32, 0.8
PUNCTUATION = ".,;:()[]{}\"'`*#<>=_|!?"

# Wordings of public licence notices.
TEMPLATES: dict[str, str] = {
    "MIT": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-text": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def normalised(text: Column) -> Column:
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, " " * len(PUNCTUATION))


def width_of(template: str) -> int:
    """Words of a template's shingles."""
    return min(SHINGLE, len(template.lower().translate(str.maketrans(PUNCTUATION, " " * len(PUNCTUATION))).split()))


def shingled(rows: DataFrame, width: int = SHINGLE) -> DataFrame:
    """rows (with text) with h, the hashes of the text's shingles in order, in place of text. Each step is a column of its own."""
    hashed = rows.withColumn("h", words(normalised(F.col("text")))).withColumn("h", word_hashes(F.col("h")))
    return hashed.withColumn("h", window_hashes(F.col("h"), width)).drop("text")


def band_value(x: Column, band: int) -> Column:
    return F.xxhash64(x, F.lit(band))


def banded(hashes: Column, band: int) -> Column:
    return F.transform(hashes, lambda x: F.struct(band_value(x, band).alias("v"), x.alias("s")))


def _index(spark: SparkSession, templates: dict[str, str], width: int) -> tuple[DataFrame, list[int], int]:
    """(band, value, license, all shingles) rows; the shingles that are smallest in some band; the longest template."""
    base = shingled(literal_table(spark, sorted(templates.items()), "license string, text string"), width).withColumnRenamed("h", "of").where(F.size("of") > 0)
    n = F.size("of")
    pieces = base.select("license", "of", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - (PIECE - 1))), lambda i: F.slice("of", i, PIECE))).alias("piece"))
    lows = F.array(*[F.array_min(banded(F.col("piece"), j)) for j in range(BANDS)])
    rows = pieces.select("license", "of", F.posexplode(lows).alias("band", "low")).select("band", F.col("low.v").alias("value"), F.col("low.s").alias("low"), "license", "of").distinct().collect()
    index = literal_table(spark, [(r["band"], r["value"], r["license"], r["of"]) for r in rows], "band int, value long, license string, of array<long>")
    return index, sorted({r["low"] for r in rows}), max(len(r["of"]) for r in rows)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, first_word, n_places, containment: a row for each document and licence found in it."""
    named: dict[int, dict[str, str]] = {}
    for name, text in (templates or TEMPLATES).items():
        if not (width := width_of(text)):
            raise ValueError(f"the template {name} has no words")
        named.setdefault(width, {})[name] = text
    found = [_scan(docs, some, width, id_col, text_col, containment) for width, some in sorted(named.items())]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _marked(known: list[int]) -> Callable[[Column], Column]:
    """Whether a hash can be one of the known: a bit for each, found by its lowest bits, so that lists of any length cost one look."""
    size = 1 << max(4, (len(known) * 16 // 64).bit_length())
    bits = [0] * size
    for x in known:
        bits[(x >> 6) % size] |= 1 << (x & 63)
    table = F.array(*[F.lit(b - (1 << 64) if b >> 63 else b).cast("long") for b in bits])
    return lambda x: F.call_function("shiftrightunsigned", F.get(table, F.shiftrightunsigned(x, 6).bitwiseAND(F.lit(size - 1)).cast("int")), x.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def _scan(docs: DataFrame, templates: dict[str, str], width: int, id_col: str, text_col: str, containment: float) -> DataFrame:
    index, lows, longest = _index(docs.sparkSession, templates, width)
    marked = _marked(lows)
    known = F.array(*[F.lit(x) for x in lows])
    reach = longest + WINDOW
    # the row number also keeps the filter above the hashing, which it would repeat below
    some = shingled(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), width).withColumn("row", F.monotonically_increasing_id()).where(F.arrays_overlap("h", known))
    # first shingle (from 0, in steps of STEP) of each window that holds a known shingle
    places = F.filter(F.transform("h", lambda x, i: F.when(marked(x) & F.array_contains(known, x), i)), lambda i: i.isNotNull())
    starts = F.array_distinct(F.flatten(F.transform(places, lambda i: F.transform(F.sequence(F.lit(0), F.lit((WINDOW - 1) // STEP)), lambda k: F.greatest(F.lit(0), (F.floor(i / STEP) - k) * STEP).cast("int")))))
    windows = some.select("doc_id", "row", "h", F.explode(starts).alias("at")).select(
        "doc_id", "row", "at", F.slice("h", F.col("at") + 1, WINDOW).alias("w"), F.slice("h", F.greatest(F.lit(0), F.col("at") - reach) + 1, 2 * reach + WINDOW).alias("around"), F.greatest(F.lit(0), F.col("at") - reach).alias("from")
    )
    low = F.array(*[F.array_min(banded(F.col("w"), j))["v"] for j in range(BANDS)])
    met = (
        windows.select("doc_id", "row", "at", "from", "around", F.posexplode(low).alias("band", "value"))
        .join(F.broadcast(index), ["band", "value"])  # one row for each band of each piece of the parameter's templates
        .select("doc_id", "row", "at", "from", "around", "license", "of")
        .distinct()
    )
    verified = (
        met.withColumn("containment", F.size(F.array_intersect("of", "around")) / F.size(F.array_distinct("of")))
        .where(F.col("containment") >= containment)
        .withColumn("first_word", F.col("from") + F.array_min(F.transform(F.col("of"), lambda x: F.nullif(F.array_position("around", x), F.lit(0)))) - 1)
    )
    return verified.groupBy("doc_id", "row", "license").agg(
        F.min("first_word").cast("long").alias("first_word"), F.count_distinct("first_word").alias("n_places"), F.max("containment").alias("containment")
    )
