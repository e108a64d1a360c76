"""Runs a query and its SQL on the same folder and compares their rows."""

from __future__ import annotations

import math
import os

import duckdb
from pyspark.sql import DataFrame


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in sorted(os.listdir(folder)):
        path = f"{folder}/{name}" + ("/*.parquet" if os.path.isdir(f"{folder}/{name}") else "")
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.12g}") + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(_cell, x))
    if isinstance(x, dict):
        return tuple((k, _cell(v)) for k, v in x.items())
    return x


def rows(columns: list[str], data: list) -> list[str]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr(tuple(_cell(r[i]) for i in order)) for r in data)


def same(df: DataFrame, sql: str, con: duckdb.DuckDBPyConnection) -> tuple[bool, str]:
    mine = rows(df.columns, df.collect())
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    theirs = rows(columns, cur.fetchall())
    if sorted(df.columns) != sorted(columns):
        return False, f"columns {sorted(df.columns)} and {sorted(columns)}"
    if mine != theirs:
        a, b = set(mine), set(theirs)
        return False, f"{len(mine)} and {len(theirs)} rows; only here {sorted(a - b)[:3]}; only there {sorted(b - a)[:3]}"
    return True, f"{len(mine)} rows"
