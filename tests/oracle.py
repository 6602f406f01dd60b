"""Runs a query and its SQL over the same directory and compares the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")


def connect(directory: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for p in glob.glob(f"{directory}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return "null"
        if hasattr(v, "tolist") and not hasattr(v, "item"):
            return str(v.tolist())
        v = v.item() if hasattr(v, "item") and getattr(v, "size", 1) == 1 else v
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"{float(v):.6f}"
        return str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False))


def same(spark, name: str, run, sql: str, con, directory: str = DATA) -> None:
    got, want = run(spark, directory).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns), name
    assert rows(got) == rows(want), name
