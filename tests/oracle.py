"""Compare a query with its SQL on DuckDB, as a multiset of rows."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(p).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def _plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    text = lambda v: "~" if v is None or v is pd.NA or v is pd.NaT or v != v else str(v)[:10] if hasattr(v, "year") else repr(round(float(v), 9)) if isinstance(v, float) else str(int(v)) if hasattr(v, "__index__") else str(v)
    cells = [[text(float(v) if isinstance(v, float) else v) for v in df[c].astype(object)] for c in df.columns]
    return sorted(zip(*cells))


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty if both have the same rows."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    norm = lambda rows: [tuple(x.removesuffix(".0") for x in r) for r in rows]
    a, b = norm(_plain(got)), norm(_plain(want))
    if a == b:
        return ""
    only = [x for x in zip(a, b) if x[0] != x[1]][:2]
    return f"{len(a)} and {len(b)} rows; first differing: {only}"
