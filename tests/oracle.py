"""Compare a registered query with its SQL in DuckDB."""

from __future__ import annotations

import decimal
import glob
import os
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if glob.glob(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


SPENT = {"spark": 0.0}


def _kind(value):
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, (float, decimal.Decimal)):
        return "float"
    return type(value).__name__


def _key(row):
    return tuple((v is None, str(type(v)), v if not isinstance(v, list) else str(v)) for v in row)


def compare(spark, sf_dir: str, fn, sql: str) -> str | None:
    """None when equal, else what differs."""
    start = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    SPENT["spark"] = time.time() - start
    con = connect(sf_dir)
    con.execute("SET threads TO 8")
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = [tuple(r[i] for i in at) for r in rel.fetchall()]
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for c, i in zip(cols, range(len(cols))):
        kinds = {_kind(r[i]) for r in got if r[i] is not None}, {
            _kind(r[i]) for r in want if r[i] is not None
        }
        if kinds[0] != kinds[1]:
            return f"kind of {c}: {kinds}"
    got.sort(key=_key)
    want.sort(key=_key)
    for a, b in zip(got, want):
        if a != b:
            return f"row {a} != {b}"
    return None
