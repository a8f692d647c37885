"""Rows of Spark and DuckDB in one comparable form."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os


def plain(v) -> str:
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = int(v) if v == int(v) else float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def assert_same(df, con, sql: str) -> None:
    columns = sorted(df.columns)
    assert columns == sorted(con.sql(sql).columns)
    names = ",".join(f'"{c}"' for c in columns)
    want = sorted("|".join(map(plain, row)) for row in con.sql(f"SELECT {names} FROM ({sql})").fetchall())
    got = sorted("|".join(map(plain, row)) for row in df.select(*columns).collect())
    assert got == want
