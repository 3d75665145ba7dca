"""Runs a query and its SQL on the same tables and compares rows, whatever their order."""

from __future__ import annotations

import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{source}'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return tuple(_norm(x) for x in v) if isinstance(v, (list, tuple)) else v


def rows_of_spark(df) -> list[tuple]:
    names = sorted(df.columns)
    return sorted((tuple(_norm(r[c]) for c in names) for r in df.collect()), key=repr)


def rows_of_sql(con, sql: str, columns: list[str]) -> list[tuple]:
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(columns)
    at = [names.index(c) for c in sorted(names)]
    return sorted((tuple(_norm(r[i]) for i in at) for r in cur.fetchall()), key=repr)
