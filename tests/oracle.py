"""Compares a query with its SQL run by DuckDB: same columns and the same rows, in any order; doubles to nine digits."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(path := f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty if all is equal, else what differs."""
    got = query(spark, sf_dir)
    rel = con.sql(sql)
    names = sorted(got.columns)
    if names != sorted(rel.columns):
        return f"columns {names} and {sorted(rel.columns)}"
    key = lambda r: (*[(x is None, str(x)) for x in r if not isinstance(x, float)], *[f"{x:.5g}" for x in r if isinstance(x, float)])
    same = lambda x, y: x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9))
    a = sorted((tuple(r[n] for n in names) for r in got.collect()), key=key)
    b = sorted((tuple(r[rel.columns.index(n)] for n in names) for r in rel.fetchall()), key=key)
    if len(a) != len(b):
        return f"{len(a)} rows and {len(b)}"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if not all(map(same, x, y))]
    return f"{len(bad)} rows differ: {bad[:3]}" if bad else ""
