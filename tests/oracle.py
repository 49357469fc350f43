"""Compare queries with their SQL over the same tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return "null"
    if hasattr(v, "tolist") and not isinstance(v, str | bytes):
        v = v.tolist()
    if isinstance(v, list | tuple):
        return str([_plain(x) for x in v])
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v:.6f}"
    if isinstance(v, int) and not isinstance(v, bool):
        return f"{v:.6f}"
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(_plain, r)) for r in df.itertuples(index=False, name=None))
