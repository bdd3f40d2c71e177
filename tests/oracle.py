"""Compare a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import decimal
import glob
import os

import duckdb


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return str(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    made = [tuple(plain(r[k]) for k in order) for r in rows]
    return sorted(columns), sorted(made, key=lambda r: [(v is None, str(type(v)), str(v)) for v in r])


def oracle(sql: str, sf_dir: str):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got = con.execute(sql)
    return rows_of([d[0] for d in got.description], got.fetchall())
