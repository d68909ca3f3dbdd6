"""Comparison of a query with its SQL."""

import math
import os

import duckdb

SF = "/root/testdata/sf0.001"


def connect(sf=SF):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return c


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    return round(float(x), 5) + 0.0 if type(x).__name__ == "Decimal" else x


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=str), [columns[i] for i in order]


def compare(c, df, sql):
    q = c.sql(sql)
    assert table([tuple(r) for r in df.collect()], df.columns) == table(q.fetchall(), q.columns)
