"""Compares a query with its DuckDB SQL: column names, and rows in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _rows(columns: list[str], rows: list) -> list:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    clean = lambda v: None if v is None else round(v, 6) + 0.0 if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(clean(r[k]) for k in order) for r in rows), key=repr)


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if they agree, else what differs."""
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = _rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    return next((f"{a} and {b}" for a, b in zip(got, want) if a != b), "")
