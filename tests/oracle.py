"""Running a query beside its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def database():
    c = duckdb.connect()
    for name in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return c


def plain(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, float | decimal.Decimal):
        return "nan" if math.isnan(v) else float(f"{float(v):.10g}")
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, bytearray):
        return bytes(v)
    if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime):
        return datetime.datetime(v.year, v.month, v.day)
    return v


def same(spark, db, query, sql: str) -> None:
    df = query(spark, FOLDER)
    got = sorted((tuple(map(plain, r)) for r in df.collect()), key=repr)
    cursor = db.execute(sql)
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(r[names.index(c)]) for c in df.columns) for r in cursor.fetchall()), key=repr)
    assert got == want
