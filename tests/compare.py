"""Rows of Spark and DuckDB as comparable multisets."""

import datetime
from collections import Counter

import pandas as pd


def _plain(v):
    if isinstance(v, (list, dict)) or hasattr(v, "shape"):
        return str(v)
    if pd.isna(v):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, float):
        return str(int(v)) if abs(v) < 1e15 and v == int(v) else str(round(v, 6))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v.isoformat() + "T00:00:00" if isinstance(v, datetime.date) else str(v)


def rows(frame: pd.DataFrame) -> Counter:
    return Counter(tuple(_plain(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con
