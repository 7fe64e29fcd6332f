"""Runs SQL of a query in DuckDB and compares the rows."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.split('.')[0]} as select * from '{sf_dir}/{name}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    """Sorted rows of text, numbers rounded to 5 digits."""

    def text(v: object) -> str:
        if hasattr(v, "tolist"):
            v = v.tolist()
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
            return "~"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, int | float):
            return f"{round(float(v), 5) + 0.0:.5f}"
        return str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(text, r)) for r in df.astype(object).itertuples(index=False))
