"""Holding a query against its DuckDB SQL."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def connect(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{sf_dir}/{name}')")
    return con


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    """Rows in a form that does not depend on the engine's types, sorted."""

    def plain(v: object) -> str:
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, float):
            return repr(round(v, 5) + 0.0)
        return repr(float(v)) if hasattr(v, "dtype") and v.dtype.kind in "iuf" and v.ndim == 0 else str(float(v)) if isinstance(v, int) and not isinstance(v, bool) else str(v)

    ordered = df[sorted(df.columns)]
    return sorted(tuple(plain(v) for v in r) for r in ordered.itertuples(index=False))


def agree(spark, con, query, sql: str, sf_dir: str = SF) -> None:
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
