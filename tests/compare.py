"""Rows of a Spark query against those of DuckDB SQL over the same tables."""

import datetime
import decimal
import math
import os

import duckdb


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(norm(x[c]) for c in cols) for x in df.collect()), key=repr)


def oracle(sf_dir, sql, cols):
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.execute(f"create view {t.split('.')[0]} as select * from '{sf_dir}/{t}'")
    c = con.execute(sql)
    names = [d[0] for d in c.description]
    assert sorted(names) == cols
    at = [names.index(n) for n in cols]
    return sorted((tuple(norm(x[i]) for i in at) for x in c.fetchall()), key=repr)
