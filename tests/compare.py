"""Compare a query with its SQL counterpart, ignoring row and column order."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "<null>" if pd.isna(v) else _text(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def _text(v) -> str:
    if hasattr(v, "isoformat"):
        text = v.isoformat()
        return text.removesuffix("T00:00:00")
    if isinstance(v, float) and v == int(v):
        return str(int(v))
    return repr(v) if isinstance(v, float) else str(v)


def difference(mine: pd.DataFrame, other: pd.DataFrame) -> str | None:
    """What differs, or None."""
    if sorted(mine.columns) != sorted(other.columns):
        return f"columns {sorted(mine.columns)} / {sorted(other.columns)}"
    if len(mine) != len(other):
        return f"rows {len(mine)} / {len(other)}"
    a, b = normal(mine), normal(other)
    wrong = (a != b).any(axis=1)
    if wrong.any():
        return f"{wrong.sum()} rows differ, first:\n{a[wrong].head(4)}\n{b[wrong].head(4)}"
    return None
