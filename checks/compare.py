"""Run registered queries against DuckDB and report differences."""

from __future__ import annotations

import math
import os
import time
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(root, t)}.parquet')")
    return con


def _plain(v):
    if isinstance(v, Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, query, text, root) -> dict:
    """Counts, columns, types and values of both sides."""
    t0 = time.time()
    df = query(spark, root)
    mine = df.collect()
    t1 = time.time()
    cur = con.execute(text)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    theirs = cur.fetchall()
    t2 = time.time()
    a, b = rows_of(df.columns, mine), rows_of(names, theirs)
    same_names = sorted(df.columns) == sorted(names)
    return {
        "ok": same_names and a == b,
        "rows": (len(mine), len(theirs)),
        "columns": sorted(df.columns) if same_names else (sorted(df.columns), sorted(names)),
        "types": {c: (t, types.get(c)) for c, t in df.dtypes},
        "only_spark": list((a - b).items())[:3],
        "only_duckdb": list((b - a).items())[:3],
        "sec": (round(t1 - t0, 2), round(t2 - t1, 2)),
    }
