"""Bringing small aggregates back to the rows they describe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import scratch_folder

#: So many rows of a small table may be broadcast.
BROADCAST_ROWS = 100_000


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared scratch folder, which outlives lost executors."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """The rows kept, and whether a count shows them few enough to be broadcast."""
    rows = kept(df, name)
    return rows, rows.count() <= BROADCAST_ROWS


def same_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality, so series with a missing label still match."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[f"_r_{k}"])
    return cond


def attach(
    df: DataFrame,
    stats: DataFrame,
    by: Sequence[str] = (),
    *,
    few_groups: bool = False,
    how: str = "left",
) -> DataFrame:
    """Add the columns of `stats` (one row per group) to every row of `df`.

    Without keys the single row comes in as a scalar subquery. With keys it is an
    equi-join: with `few_groups`, for keys that should have few values (environment,
    stage, cluster), the groups are written out and counted, and broadcast if they are
    few; otherwise Spark picks the join from the measured sizes and splits skewed keys.
    """
    extra = [c for c in stats.columns if c not in by]
    if not by:
        one = stats.select(F.struct(*extra).alias("_one"))
        return df.withColumn("_one", one.scalar()).select(*df.columns, *[f"_one.{c}" for c in extra])
    right = stats.select(*[F.col(k).alias(f"_r_{k}") for k in by], *extra)
    if few_groups:
        right, few = sized(right, "groups")
        right = F.broadcast(right) if few else right
    return df.join(right, same_key(df, right, by), how).select(*df.columns, *extra)
