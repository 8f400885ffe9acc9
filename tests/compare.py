"""Rows of a query and of its SQL, as sorted tuples."""

import os

import duckdb
import pandas as pd


def views(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return con


def _plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
        return bool(v)
    if isinstance(v, float):
        return round(v, 9)
    return list(v) if hasattr(v, "tolist") and getattr(v, "shape", ()) else v


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    out = []
    for row in pdf.itertuples(index=False):
        values = map(_plain, row)
        out.append(tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in values))
    return sorted(out, key=repr)
