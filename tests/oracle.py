"""Compares a registered query with its SQL on a size of the test data."""

import math
import os

import duckdb


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return repr(round(x, 6) + 0.0)
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def check(spark, name, query, sql, sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    df, want = query(spark, sf_dir), con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns), name
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(want.columns, want.fetchall()), name
