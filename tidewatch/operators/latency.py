"""Latency per pipeline stage and its distribution (LAT).

Group keys are normally the environment or stage, of which there are a few; pass
`few_groups=True` is for callers who know that a key has few values; it allows a broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.timeutil import bucket, micros, seconds_between
from tidewatch.operators.joins import attach
from tidewatch.operators.quantiles import exact_quantiles

# Stage column, display name and display order.
STAGES = {
    "source_broker_latency": ("Kafka", 1),
    "broker_landing_latency": ("Spark", 2),
    "total_latency": ("Total", 3),
}
ENVIRONMENTS = ["Edge", "Cloud"]


def stage_latencies(df: DataFrame, source: str | None, broker: str, landing: str) -> DataFrame:
    """Seconds source→broker, broker→landing and their sum; without a source, landing only."""
    spark_part = seconds_between(landing, broker)
    if source is None:
        return df.withColumn("broker_landing_latency", spark_part)
    broker_part = seconds_between(broker, source)
    return df.withColumns(
        {
            "source_broker_latency": broker_part,
            "broker_landing_latency": spark_part,
            "total_latency": broker_part + spark_part,
        }
    )


def latency_long(
    df: DataFrame,
    stages: Mapping[str, tuple[str, int]] = STAGES,
    ids: Sequence[str] = ("environment",),
) -> DataFrame:
    """One row per message and stage: ids, stage, stage_order, latency."""
    missing = [c for c in [*stages, *ids] if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    wide = df.select(*ids, *[F.col(c).alias(label) for c, (label, _) in stages.items()])
    long = wide.unpivot(list(ids), [label for label, _ in stages.values()], "stage", "latency")
    order = F.create_map(*[F.lit(x) for label, rank in stages.values() for x in (label, rank)])
    return long.select(*ids, "stage", order[F.col("stage")].alias("stage_order"), "latency")


def latency_summary(
    long: DataFrame,
    by: Sequence[str] = ("stage", "environment"),
    value: str = "latency",
    *,
    factor: float = 1000.0,
    digits: int = 1,
    approx: bool = False,
    few_groups: bool = False,
) -> DataFrame:
    """Median, inter-quartile range and p95 per group, in ms for values in seconds.

    `approx` swaps the exact quantiles for Spark's mergeable sketch.
    """
    probs = [0.25, 0.5, 0.75, 0.95]
    if approx:
        q = long.groupBy(*by).agg(F.percentile_approx(value, probs, 100_000).alias("q"))
    else:
        q = exact_quantiles(long, by, value, probs)

    def ms(col):
        return F.round(col * factor, digits)

    return q.select(
        *by,
        ms(F.col("q")[1]).alias("median_ms"),
        ms(F.col("q")[2] - F.col("q")[0]).alias("iqr_ms"),
        ms(F.col("q")[3]).alias("p95_ms"),
    )


def latency_summary_wide(
    summary: DataFrame,
    envs: Sequence[str] = ENVIRONMENTS,
    stats: Sequence[str] = ("median_ms", "iqr_ms", "p95_ms"),
    *,
    fill: float | None = None,
) -> DataFrame:
    """One row per stage, one column per statistic and environment."""
    wide = (
        summary.groupBy("stage")
        .pivot("environment", list(envs))
        .agg(*[F.max(s).alias(s) for s in stats])
        .select(
            "stage", *[F.col(f"{e}_{s}").alias(f"{s[:-3]}_{e.lower()}_ms") for s in stats for e in envs]
        )
    )
    return wide if fill is None else wide.na.fill(fill)


def summary_value(summary: DataFrame, stage: str, stat: str, environment: str) -> DataFrame:
    """A single statistic, as a one-row frame."""
    hit = (F.col("stage") == stage) & (F.col("environment") == environment)
    return summary.where(hit).select(F.col(stat).alias("value"))


def report_sentences(summary: DataFrame) -> DataFrame:
    """One sentence per stage and environment."""
    text = F.format_string(
        "%s latency in %s: median %.1f ms, IQR %.1f ms, 95th percentile %.1f ms",
        "stage",
        "environment",
        "median_ms",
        "iqr_ms",
        "p95_ms",
    )
    return summary.select("stage", "environment", text.alias("sentence"))


def env_stats(df: DataFrame, col: str, by: Sequence[str] = ("environment",), *, few_groups: bool = False) -> DataFrame:
    """min, max, mean, median and sample standard deviation per group."""
    plain = df.groupBy(*by).agg(
        F.min(col).alias("min"),
        F.max(col).alias("max"),
        F.avg(col).alias("mean"),
        F.stddev(col).alias("std"),
    )
    mid = exact_quantiles(df, by, col, [0.5]).select(*by, F.col("q")[0].alias("median"))
    return attach(plain, mid, by, few_groups=few_groups)


def describe(df: DataFrame, col: str, by: Sequence[str] = (), *, few_groups: bool = False) -> DataFrame:
    """count, mean, std, min, quartiles, max; quartiles are exact."""
    plain = df.groupBy(*by).agg(
        F.count(col).alias("count"),
        F.avg(col).alias("mean"),
        F.stddev(col).alias("std"),
        F.min(col).alias("min"),
        F.max(col).alias("max"),
    )
    q = exact_quantiles(df, by, col, [0.25, 0.5, 0.75]).select(
        *by, F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75")
    )
    return attach(plain, q, by, few_groups=few_groups)


def describe_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """`describe` of several columns, one row each."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [], list(cols), "column", "value"
    )
    return describe(long, "value", ["column"])


def box_stats(df: DataFrame, col: str, by: Sequence[str] = ("environment",), *, few_groups: bool = False) -> DataFrame:
    """Quartiles, whiskers at the last values inside 1.5 IQR, and the outliers beyond."""
    q = exact_quantiles(df, by, col, [0.25, 0.5, 0.75]).select(
        *by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col("_v").between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        attach(_values(df, by, col), q, by, few_groups=few_groups)
        .groupBy(*by)
        .agg(
            F.max("q1").alias("q1"),
            F.max("median").alias("median"),
            F.max("q3").alias("q3"),
            F.min(F.when(inside, F.col("_v"))).alias("whisker_lo"),
            F.max(F.when(inside, F.col("_v"))).alias("whisker_hi"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def _values(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """(by, _v): the values of a column that are numbers."""
    rows = df.select(*by, F.col(col).cast("double").alias("_v"))
    return rows.where(F.col("_v").isNotNull() & ~F.isnan("_v"))


def axis_bound(
    df: DataFrame,
    col: str,
    by: Sequence[str] = ("stage",),
    over: str = "environment",
    pct: float = 99,
    pad: float = 1.1,
    few_groups: bool = False,
) -> DataFrame:
    """Upper axis limit: the largest percentile over the environments, padded."""
    q = exact_quantiles(df, [*by, over], col, [pct / 100])
    return q.groupBy(*by).agg((F.max(F.col("q")[0]) * pad).alias("bound"))


def approx_stats(df: DataFrame, cols: Sequence[str], accuracy: int = 1_000_000) -> DataFrame:
    """avg, stddev, min, max and sketch median of each column, in one pass."""
    aggs = []
    for c in cols:
        aggs += [
            F.avg(c).alias(f"avg_{c}"),
            F.stddev(c).alias(f"stddev_{c}"),
            F.min(c).alias(f"min_{c}"),
            F.max(c).alias(f"max_{c}"),
            F.percentile_approx(c, 0.5, accuracy).alias(f"median_{c}"),
        ]
    return df.agg(*aggs)


def histogram(df: DataFrame, col: str, bins: int, by: Sequence[str] = (), *, few_groups: bool = False) -> DataFrame:
    """Counts in `bins` equal bins between min and max; the last bin is closed."""
    rows = _values(df, by, col)
    span = rows.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    inner = F.least(F.width_bucket("_v", F.col("_lo"), F.col("_hi"), F.lit(bins)), F.lit(bins))
    pos = F.when(F.col("_hi") > F.col("_lo"), inner).otherwise(F.lit(1)).cast("long")
    width = (F.col("_hi") - F.col("_lo")) / bins
    return (
        attach(rows, span, by, few_groups=few_groups)
        .groupBy(*by, pos.alias("bin"))
        .agg(F.count(F.lit(1)).alias("rows"), F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
        .select(*by, "bin", (F.col("_lo") + (F.col("bin") - 1) * width).alias("bin_start"), "rows")
    )


def density(
    df: DataFrame, col: str, by: Sequence[str] = ("environment",), grid: int = 200, *, cut: float = 3.0, floor: float | None = 0.0,
    error: float = 1e-8, few_groups: bool = False,
) -> DataFrame:
    """Gaussian density on `grid` points per group: by, point, x, density.

    The bandwidth follows Scott's rule, n^(-1/5) standard deviations. The points reach
    `cut` bandwidths beyond the smallest and the largest value, but not below `floor`.

    Values are first counted, on the map side, into cells whose width is a fixed part of the
    bandwidth and stand in their cell's mean; a cell reaches only the points where its kernel
    is above `error` of the kernel's peak. Each of the two changes a point's density by at
    most `error` times that peak, 1 / (bandwidth * sqrt(2 pi)), whatever the values are.
    Groups of one value or without spread have no density and no row.
    """
    rows = _values(df, by, col)
    shape = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.stddev("_v").alias("_std")
    )
    low, high = F.col("_lo") - cut * F.col("_h"), F.col("_hi") + cut * F.col("_h")
    shape = (
        shape.withColumn("_h", F.col("_std") * F.pow("_n", F.lit(-0.2)))
        .where("_h > 0")
        .select(*by, "_n", "_h", (low if floor is None else F.greatest(low, F.lit(float(floor)))).alias("_from"), high.alias("_to"))
        .withColumn("_step", (F.col("_to") - F.col("_from")) / (grid - 1))
    )
    # a value stands at most half a cell from the mean: an error of width^2 / 8 of the peak
    width = F.col("_h") * math.sqrt(8 * error)
    cells = (
        attach(rows, shape, by, few_groups=few_groups, how="inner")
        .groupBy(*by, F.floor(F.col("_v") / width).alias("_cell"))
        .agg(F.avg("_v").alias("_x"), F.count(F.lit(1)).alias("_w"), *[F.max(c).alias(c) for c in ("_n", "_h", "_from", "_step")])
    )
    reach = F.col("_h") * math.sqrt(-2 * math.log(error))
    first = F.greatest(F.ceil((F.col("_x") - reach - F.col("_from")) / F.col("_step")), F.lit(0))
    last = F.least(F.floor((F.col("_x") + reach - F.col("_from")) / F.col("_step")), F.lit(grid - 1))
    points = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    x = F.col("_from") + F.col("point") * F.col("_step")
    kernel = F.exp(-0.5 * F.pow((x - F.col("_x")) / F.col("_h"), F.lit(2.0)))
    summed = (
        cells.withColumn("point", F.explode(points))
        .groupBy(*by, "point")
        .agg((F.sum(F.col("_w") * kernel / (F.col("_n") * F.col("_h"))) / math.sqrt(2 * math.pi)).alias("density"))
    )
    every = shape.select(*by, "_from", "_step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(grid - 1).cast("long"))).alias("point"))
    return attach(every, summed, [*by, "point"]).select(*by, "point", x.alias("x"), F.coalesce("density", F.lit(0.0)).alias("density"))


def downsample(df: DataFrame, ts: str, value: str, step: int, by: Sequence[str] = ()) -> DataFrame:
    """min, mean and max of every non-empty interval, as three rows each."""
    agg = (
        df.groupBy(*by, bucket(ts, step).alias("bucket"))
        .agg(F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max"))
        .where(F.col("mean").isNotNull())
    )
    return agg.unpivot([*by, "bucket"], ["min", "mean", "max"], "stat", value)


def latency_by_action(df: DataFrame, action: str, ts: str, value: str, step: int) -> DataFrame:
    """Latency of each action over time."""
    return df.groupBy(action, bucket(ts, step).alias("bucket")).agg(
        F.count(value).alias("messages"),
        F.min(value).alias("min"),
        F.avg(value).alias("mean"),
        F.max(value).alias("max"),
    )


def melt_deltas(df: DataFrame, view: str, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Second-truncated deltas as a temp view, then one row per delta.

    `pairs` maps the delta's name to its (later, earlier) columns.
    """
    deltas = df.select(
        *[seconds_between(a, b, truncate=True).alias(name) for name, (a, b) in pairs.items()]
    )
    deltas.createOrReplaceTempView(view)
    return df.sparkSession.table(view).unpivot([], list(pairs), "delta", "seconds")


def union_tagged(frames: Mapping[str, DataFrame], name: str = "environment") -> DataFrame:
    """Frames of several environments below each other, tagged with their name."""
    return reduce(
        lambda a, b: a.unionByName(b), [df.withColumn(name, F.lit(env)) for env, df in frames.items()]
    )


def latency_ms(later: str, earlier: str):
    return (micros(later) - micros(earlier)) / F.lit(1e3)
