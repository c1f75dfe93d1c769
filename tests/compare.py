"""Comparison of query results with DuckDB."""

import math
import os

import duckdb
import numpy as np
import pandas as pd

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def text(v) -> str:
    if isinstance(v, (list, np.ndarray, tuple)):
        return "[" + ",".join(text(x) for x in v) + "]"
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, (float, np.floating)):
        return repr(round(float(v), 6) + 0.0)
    return str(v)


def rows(names, data):
    order = sorted(names)
    return order, sorted(tuple(text(r[names.index(c)]) for c in order) for r in data)
