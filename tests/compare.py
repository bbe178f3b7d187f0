"""Comparing a query's rows with those of its SQL."""

import os

import duckdb
import pandas as pd


def connect(folder):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{f}')")
    return c


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
        return "null"
    if isinstance(x, float) or getattr(getattr(x, "dtype", None), "kind", "") == "f":
        return f"{float(x):.6f}"
    if hasattr(x, "__len__") and not isinstance(x, (str, bytes)):
        return str([plain(y) for y in x])
    return f"{float(x):.6f}" if hasattr(x, "__int__") and not isinstance(x, (str, bool)) and getattr(getattr(x, "dtype", None), "kind", "") != "b" else str(bool(x)) if not isinstance(x, (str, bytes)) else str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(plain(x) for x in r) for r in df.itertuples(index=False))
