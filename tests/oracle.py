"""Compare registered queries with their SQL on DuckDB."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(x):
    if x is None:
        return None
    if isinstance(x, float):
        return None if math.isnan(x) else f"{x + 0.0:.5f}"
    if isinstance(x, bool):
        return x
    if hasattr(x, "as_integer_ratio"):
        return int(x) if x == int(x) else f"{float(x):.5f}"
    if isinstance(x, dt.datetime):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(_value(i) for i in x)
    return x


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    data = sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)
    return names, data


def differences(spark_df, con, sql: str) -> str | None:
    """None if both give the same rows, else what differs."""
    rows = spark_df.collect()
    names, ours = _rows(spark_df.columns, rows)
    cur = con.execute(sql)
    want_names, theirs = _rows([d[0] for d in cur.description], cur.fetchall())
    if names != want_names:
        return f"columns {names} != {want_names}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    if not ours:
        return "no rows on either side"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(bad)} of {len(ours)} rows differ, first {bad[0]}" if bad else None
