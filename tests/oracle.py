"""Compares a registered query with its SQL in DuckDB: columns, types, and rows in any order."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.sql(f"create view {p.stem} as select * from '{p if p.is_file() else p / '*.parquet'}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


KIND = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> int:
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    rel = con.sql(sql)
    assert sorted(rel.columns) == names
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    for c, kind in df.dtypes:
        assert KIND.get(kind, kinds[c]) == kinds[c], (c, kind, kinds[c])
    at = [rel.columns.index(c) for c in names]
    want = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert got == want, (list((got - want).items())[:4], list((want - got).items())[:4])
    return sum(got.values())
