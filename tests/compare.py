"""Compare a query with its SQL in DuckDB: columns, row count and values, in any order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def canonical(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(canonical(r[k]) for k in order) for r in rows)


def check(df, sql: str, con) -> int:
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(names)
    got = df.collect()
    assert len(got) == len(want)
    assert rows_of(df.columns, got) == rows_of(names, want)
    return len(got)
