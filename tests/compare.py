"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import math

import duckdb

from matchbook.session import TABLES


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool):
        return str(v)
    return str(v)


def same_rows(df, con, sql: str) -> None:
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(names)
    order = [names.index(c) for c in df.columns]
    got = sorted(tuple(map(plain, r)) for r in df.collect())
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in want)
