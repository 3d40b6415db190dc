"""Comparison of a query's rows with its SQL on the same Parquet files."""

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _cell(v):
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, bool) or type(v).__name__ in ("bool", "bool_"):
        return str(bool(v))
    return f"{float(v) + 0.0:.6f}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(_cell(v) for v in r) for r in df[cols].itertuples(index=False))


def same(spark_df, con, sql):
    got, want = rows(spark_df.toPandas()), rows(con.execute(sql).df())
    assert got[0] == want[0]
    assert got[1] == want[1]
    return len(got[1])
