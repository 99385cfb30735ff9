"""Run a registered query and its oracle and compare the rows."""

from __future__ import annotations

import glob
import os
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(folder, f"{t}.parquet")
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _value(v):
    if isinstance(v, (Decimal,)):
        return int(v) if v == int(v) else float(v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(repr(_value(r[i])) for i in order) for r in rows))


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short description of the difference."""
    result = con.execute(sql)
    want_cols = [c[0] for c in result.description]
    want = _rows(want_cols, result.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(want_cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(want_cols)}"
    if got == want:
        return None
    extra = sorted(set(got) - set(want))[:3]
    missing = sorted(set(want) - set(got))[:3]
    return f"rows {len(got)} != {len(want)}\n  columns {sorted(df.columns)}\n  only here  {extra}\n  only there {missing}"
