"""Rows of a query against rows of its SQL in DuckDB."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if Path(path).exists():
            con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(x):
    if x is None or x is pd.NA or x != x:
        return ""
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, bool):
        return str(x)
    return f"{float(x):.9g}" if isinstance(x, (int, float)) or type(x).__name__ == "Decimal" else str(x)


def rows_of(frame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted(tuple(plain(x) for x in row) for row in frame[columns].astype(object).itertuples(index=False))


def differences(query, sql: str, spark, sf_dir: str) -> str:
    got, want = query(spark, sf_dir).toPandas(), connect(sf_dir).execute(sql).fetch_df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows_of(got), rows_of(want)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows; {[x for x in a if x not in b][:2]} {[x for x in b if x not in a][:2]}"
    return next((f"{x} and {y}" for x, y in zip(a, b) if x != y), "")
