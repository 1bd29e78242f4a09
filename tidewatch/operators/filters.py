"""Row filters (FLT)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.naming import starts_with_any
from tidewatch.operators.joins import attach
from tidewatch.operators.quantiles import exact_ranks


def time_range(df: DataFrame, ts: str, start, end, inclusive: bool = True) -> DataFrame:
    """Rows between two times; bounds are literals, so the filter reaches the scan."""
    c, lo, hi = F.col(ts), F.lit(start), F.lit(end)
    return df.where(c.between(lo, hi) if inclusive else (c > lo) & (c < hi))


def common_end(a: DataFrame, b: DataFrame, ts: str, start=None) -> tuple[DataFrame, DataFrame]:
    """Both frames up to the earlier of their last times, optionally from `start`."""
    last_a = a.agg(F.max(ts).alias("t")).scalar()
    last_b = b.agg(F.max(ts).alias("t")).scalar()

    def cut(df: DataFrame) -> DataFrame:
        keep = F.col(ts) <= F.least(last_a, last_b)
        if start is not None:
            keep = keep & (F.col(ts) >= F.lit(start))
        return df.where(keep)

    return cut(a), cut(b)


def around(df: DataFrame, ts: str, center, minutes: float = 20) -> DataFrame:
    span = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(minutes * 60.0))
    mid = center if isinstance(center, Column) else F.lit(center)
    return df.where(F.col(ts).between(mid - span, mid + span))


def where_labels(df: DataFrame, **labels) -> DataFrame:
    """Label equals a value, or is one of several."""
    for name, value in labels.items():
        many = isinstance(value, (list, tuple, set))
        df = df.where(F.col(name).isin(list(value)) if many else F.col(name) == F.lit(value))
    return df


def where_prefix(df: DataFrame, col: str, prefixes: Sequence[str]) -> DataFrame:
    return df.where(starts_with_any(col, prefixes))


def where_contains(df: DataFrame, col: str, words: Sequence[str]) -> DataFrame:
    """Case-insensitive substring match of any word."""
    cond = F.lit(False)
    for w in words:
        cond = cond | F.lower(F.col(col)).contains(w.lower())
    return df.where(cond)


def labelled(df: DataFrame, *labels: str) -> DataFrame:
    """Drop samples without these labels."""
    return df.dropna(subset=list(labels))


def without_value(df: DataFrame, col: str, value) -> DataFrame:
    """Drop one value and keep rows where the label is missing."""
    return df.where(~F.col(col).eqNullSafe(F.lit(value)))


def same_time(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a) == F.col(b))


def count_negative(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count_if(F.col(col) < 0).alias("negative"), F.count(F.lit(1)).alias("total")
    )


def slice_rows(df: DataFrame, order: Sequence[str], start: int, stop: int) -> DataFrame:
    """Rows start..stop-1 of the sorted frame (a top-k, no full sort)."""
    return df.orderBy(*order).limit(stop).offset(start)


def quantile_bounds(
    df: DataFrame,
    limits: Mapping[str, tuple[float | None, float | None]],
    by: Sequence[str] = (),
    *,
    few_groups: bool = False,
) -> DataFrame:
    """One row per group with `<col>_lo` and `<col>_hi`; all columns are looked at together."""
    cols = list(limits)
    probs = sorted({p for pair in limits.values() for p in pair if p is not None})
    q = exact_ranks(df, by, cols, probs)
    picks = [
        F.max(F.when(F.col("_col") == i, F.col("q")[probs.index(p)])).alias(f"{col}_{end}")
        for i, col in enumerate(cols)
        for end, p in zip(("lo", "hi"), limits[col], strict=True)
        if p is not None
    ]
    return q.groupBy(*by).agg(*picks)


def trim_quantiles(
    df: DataFrame,
    limits: Mapping[str, tuple[float | None, float | None]],
    *,
    lo_strict: bool = False,
    hi_strict: bool = False,
    by: Sequence[str] = (),
    few_groups: bool = False,
) -> DataFrame:
    """Keep rows whose columns lie between their quantiles, all columns at once."""
    bounds = quantile_bounds(df, limits, by, few_groups=few_groups)
    out = attach(df, bounds, by, few_groups=few_groups)
    keep = F.lit(True)
    for col, (lo, hi) in limits.items():
        c = F.col(col)
        if lo is not None:
            keep = keep & ((c > F.col(f"{col}_lo")) if lo_strict else (c >= F.col(f"{col}_lo")))
        if hi is not None:
            keep = keep & ((c < F.col(f"{col}_hi")) if hi_strict else (c <= F.col(f"{col}_hi")))
    return out.where(keep).select(*df.columns)


def trim_report(df: DataFrame, col: str, lo: float | None, hi: float | None, **kwargs) -> DataFrame:
    """How many rows a trim keeps and removes."""
    kept = trim_quantiles(df, {col: (lo, hi)}, **kwargs).agg(F.count(F.lit(1)).alias("kept"))
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", kept.scalar().alias("kept"), (F.col("total") - kept.scalar()).alias("removed")
    )
