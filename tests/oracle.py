"""Compares a Spark result with DuckDB's answer to the same question."""

import os

import duckdb
import numpy as np
import pandas as pd


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.integer, np.floating)):
        return round(float(v), 9)
    return str(v)


def rows(frame):
    cols = sorted(frame.columns)
    return sorted(map(repr, (tuple(plain(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False))))


def answer(sql, folder):
    c = duckdb.connect()
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{folder}/{f}'")
    return c.sql(sql).df()
