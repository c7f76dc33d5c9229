"""Comparison of a query with its SQL: sorted columns, order-insensitive rows, floats to 6 places."""

import decimal
import math
import os

import duckdb


def connect(d):
    con = duckdb.connect()
    for t in os.listdir(d):
        p = f"{d}/{t}"
        con.sql(f"create view {t.split('.')[0]} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    con.sql("set timezone='UTC'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def same(df, con, sql):
    cols = sorted(df.columns)
    r = con.sql(sql)
    assert sorted(r.columns) == cols
    a = sorted((tuple(norm(x[c]) for c in cols) for x in df.collect()), key=repr)
    at = [r.columns.index(c) for c in cols]
    b = sorted((tuple(norm(x[i]) for i in at) for x in r.fetchall()), key=repr)
    assert a == b
