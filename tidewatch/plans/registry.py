"""The list of named queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIGITS = 6


def _rounded(c):
    """Round half away from zero, in plain double arithmetic as DuckDB does it."""
    scale = 10.0**DIGITS
    near = F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale + 0.0
    return F.when(F.abs(c) < 9e12, near).otherwise(c)


def _comparable(df: DataFrame) -> DataFrame:
    """Times without zone and rounded doubles, so both engines print the same values."""
    cols = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, T.DoubleType):
            c = _rounded(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None, doubles: Sequence[str] = ()):
    """Register a query; `doubles` names the SQL columns to round."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            use_utc(spark)
            return _comparable(fn(spark, folder))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            rounded = ", ".join(f"round({c}, {DIGITS}) + 0::DOUBLE AS {c}" for c in doubles)
            SQL[name] = f"SELECT * REPLACE ({rounded}) FROM ({sql})" if doubles else sql
        return fn

    return register
