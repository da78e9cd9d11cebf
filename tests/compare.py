"""Comparison of a Spark result with DuckDB's answer to the oracle SQL, order and column order aside."""

from __future__ import annotations

import datetime as dt
import os
from decimal import Decimal
from pathlib import Path

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def oracle(sql: str, sf_dir: str = DATA) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p / '*.parquet' if p.is_dir() else p}')")
    found = con.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


def plain(v):
    if isinstance(v, (float, Decimal)):
        return f"{float(v):.6g}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return "-" if v is None else str(v)


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def check(spark, queries: dict, oracles: dict, name: str, sf_dir: str = DATA) -> None:
    df = queries[name](spark, sf_dir)
    columns, wanted = oracle(oracles[name], sf_dir)
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, wanted)
