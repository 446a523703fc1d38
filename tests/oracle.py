"""Runs queries against their SQL oracles in DuckDB, as the driver does: columns by name, rows in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool):
        return (1, v)
    if isinstance(v, (int, float)):
        return (2, round(float(v), 5))
    if hasattr(v, "isoformat"):
        return (3, v.isoformat()[:19].removesuffix("T00:00:00"))
    return (4, str(v))


def differences(df, con, sql: str) -> str:
    """Empty if both have the same columns and rows."""
    got_cols = sorted(df.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if got_cols != sorted(names):
        return f"columns {got_cols} and {sorted(names)}"
    want = sorted((tuple(cell(r[names.index(c)]) for c in got_cols) for r in cur.fetchall()), key=str)
    got = sorted((tuple(cell(r[c]) for c in got_cols) for r in df.collect()), key=str)
    if len(got) != len(want):
        return f"{len(got)} rows, {len(want)} expected"
    close = lambda a, b: a == b or (a[0] == b[0] == 2 and abs(a[1] - b[1]) <= 2e-5 * max(1, abs(b[1])))
    for g, w in zip(got, want, strict=True):
        if not all(map(close, g, w)):
            return f"{[(c, x[1], y[1]) for c, x, y in zip(got_cols, g, w, strict=True) if not close(x, y)]}"
    return ""
