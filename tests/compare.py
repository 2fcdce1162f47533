"""Compares a Spark result with DuckDB's, as sets of rows with columns by name."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, Decimal)):
        return round(float(v), 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def oracle(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.sql(sql)
    return got.columns, got.fetchall()


def difference(df, sql: str, sf_dir: str) -> str:
    """Empty if both agree, else what differs."""
    columns, rows = oracle(sql, sf_dir)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    mine, theirs = rows_of(df.columns, df.collect()), rows_of(columns, rows)
    if mine == theirs:
        return ""
    other = set(map(repr, theirs))
    own = set(map(repr, mine))
    return f"{len(mine)} rows against {len(theirs)}; only here {sorted(own - other)[:3]}; only there {sorted(other - own)[:3]}"
