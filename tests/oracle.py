"""Compares queries with their SQL on DuckDB over the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([_plain(r[i]) for i in order] for r in rows), key=repr)


def differences(spark, folder: str, query, sql: str) -> str:
    """What differs; empty if nothing does."""
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    df = query(spark, folder)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    got, want = _rows(df.columns, [tuple(r) for r in df.collect()]), _rows(names, want.fetchall())
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return f"{len(bad)} rows differ: {bad[:2]}" if bad else ""
