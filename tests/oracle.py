"""Compare queries with their SQL, as the driver does: rows, columns, and values in any order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    if isinstance(v, float):
        return round(v, 6)
    return v


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def differences(spark, name: str, query, sql: str, sf_dir: str) -> str:
    got = query(spark, sf_dir)
    ours = rows(got.columns, [tuple(r) for r in got.collect()])
    cur = connect(sf_dir).execute(sql)
    columns = [d[0] for d in cur.description]
    theirs = rows(columns, cur.fetchall())
    if sorted(columns) != sorted(got.columns):
        return f"{name}: columns {sorted(got.columns)}, SQL has {sorted(columns)}"
    if len(ours) != len(theirs):
        return f"{name}: {len(ours)} rows, SQL has {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{name}: {len(bad)} of {len(ours)} rows differ, first {bad[0]}" if bad else ""
