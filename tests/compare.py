"""Rows of a Spark result and of a DuckDB query as comparable lists."""

import math
import os

import duckdb
import pandas as pd


def duck(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.sql(f"CREATE VIEW {name[:-8]} AS FROM '{folder}/{name}'")
    return con


def rows(frame):
    def plain(v):
        if isinstance(v, float):
            if math.isnan(v):
                return None
            if v == int(v) and abs(v) < 1e15:
                return int(v)
        return None if v is pd.NaT or v is pd.NA else v.tolist() if hasattr(v, "tolist") else v

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(str(plain(v)) for v in row) for row in frame.itertuples(index=False))
