"""Compares registered queries with their SQL oracles in DuckDB."""

from __future__ import annotations

import glob
import math
import os
from decimal import Decimal


def views(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def differences(df, con, sql: str) -> str:
    """Empty if columns and rows agree; floats may differ in their last rounded digit."""
    cols = sorted(df.columns)
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} and {sorted(rel.columns)}"
    key = lambda r: tuple((x is None, str(type(x)), round(x, 2) if isinstance(x, float) else str(x)) for x in r)
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    order = [rel.columns.index(c) for c in cols]
    theirs = sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=key)
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    bad = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    return f"{len(bad)} rows differ, as {bad[0]}" if bad else ""
