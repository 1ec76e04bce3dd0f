"""Compares a Spark result with a SQL result: same columns, same rows in any order."""

from __future__ import annotations

import glob
import os
from collections import Counter
from decimal import Decimal

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, (Decimal, float)):
        return float(value)
    return value


def _bag(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    mine = df.collect()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    a, b = _bag(df.columns, mine), _bag(names, theirs)
    if a == b:
        return None
    return (
        f"{len(mine)} rows against {len(theirs)}; "
        f"only Spark {list((a - b).items())[:3]}; only SQL {list((b - a).items())[:3]}"
    )
