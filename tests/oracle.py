"""Compares a query's rows with those of its SQL twin in DuckDB, whatever their order."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def assert_same(df, sql: str, sf_dir: str) -> None:
    got = bag(df.columns, [tuple(r) for r in df.collect()])
    c = connect(sf_dir)
    c.execute(sql)
    names, rows = [x[0] for x in c.description], c.fetchall()
    assert sorted(df.columns) == sorted(names)
    want = bag(names, rows)
    if got != want:
        only_got, only_want = list((got - want).items())[:3], list((want - got).items())[:3]
        raise AssertionError(f"{sum(got.values())} and {sum(want.values())} rows; only here: {only_got}; only in SQL: {only_want}")
