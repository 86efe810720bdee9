"""Runs a query and its SQL on the same tables and compares columns and rows."""

import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(folder: str = DATA):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


def compare(spark, con, query, sql: str, folder: str = DATA) -> None:
    df = query(spark, folder)
    ours, cols = df.collect(), sorted(df.columns)
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    theirs = r.fetchall()
    assert cols == sorted(names)
    a = sorted((tuple(norm(x[c]) for c in cols) for x in ours), key=str)
    b = sorted((tuple(norm(x[names.index(c)]) for c in cols) for x in theirs), key=str)
    assert len(a) == len(b)
    assert a == b
