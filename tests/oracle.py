"""Compares a query's rows with DuckDB's, order-insensitively and by exact values."""

import glob
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connect(folder):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def _text(v):
    return repr(float(v)) if isinstance(v, float) else repr(v)


def _rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(_text(r[k]) for k in order) for r in values)


def assert_same(df, con, sql):
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    a, b = _rows(df.columns, df.collect()), _rows(names, want.fetchall())
    assert len(a) == len(b)
    assert a == b
    return len(a)
