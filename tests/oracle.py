"""Runs a registered query's SQL in DuckDB and compares rows."""

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    return int(x) if isinstance(x, int) else x


def compare(df, con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = Counter(tuple(plain(v) for _, v in sorted(zip(names, row))) for row in cur.fetchall())
    got = Counter(tuple(plain(v) for _, v in sorted(zip(df.columns, row))) for row in df.collect())
    assert sorted(df.columns) == sorted(names)
    extra, lost = list((got - want).items())[:3], list((want - got).items())[:3]
    assert got == want, f"extra {extra}, lost {lost}, {sum(got.values())} and {sum(want.values())} rows"
