"""Comparison of a query with its SQL on the same parquet tables."""

import collections
import glob
import math
import os

import duckdb


def connect(d):
    c = duckdb.connect()
    for f in glob.glob(f"{d}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


def same(df, con, sql):
    rows, cols = [tuple(r) for r in df.collect()], df.columns
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(cols) == sorted(names)
    order = sorted(cols)
    count = lambda rs, cs: collections.Counter(tuple(norm(r[cs.index(k)]) for k in order) for r in rs)
    a, b = count(rows, cols), count(cur.fetchall(), names)
    assert a == b, (list((a - b))[:3], list((b - a))[:3])
