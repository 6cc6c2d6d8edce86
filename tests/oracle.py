"""Compares a query with its SQL on the same tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("GRIDCAST_TESTDATA", "/root/testdata")


def connection(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def _plain(v: object) -> object:
    if isinstance(v, float):
        return None if math.isnan(v) else 0.0 if v == 0 else v
    return v


def compare(df, sql: str, con: duckdb.DuckDBPyConnection) -> None:  # noqa: ANN001
    names = sorted(df.columns)
    result = con.execute(sql)
    assert sorted(d[0] for d in result.description) == names
    order = [[d[0] for d in result.description].index(n) for n in names]
    want = sorted((tuple(_plain(r[k]) for k in order) for r in result.fetchall()), key=repr)
    got = sorted((tuple(_plain(v) for v in r) for r in df.select(*names).collect()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == b
