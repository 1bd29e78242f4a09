"""Load-test results and message intervals (LDT)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.timeutil import micros, relative_seconds, seconds_between
from tidewatch.operators.filters import trim_quantiles
from tidewatch.operators.joins import attach
from tidewatch.operators.latency import describe, downsample
from tidewatch.operators.ordered import Ordered
from tidewatch.operators.quantiles import exact_quantiles

# Metric, statistic, comparison and limit of each service level.
SLO_RULES = [
    ("dropped_iterations", "count", "==", 0.0),
    ("kafka_writer_error_count", "count", "==", 0.0),
    ("kafka_writer_write_seconds", "p95", "<", 100.0),
    ("kafka_writer_wait_seconds", "p95", "<", 0.100),
    ("kafka_writer_wait_seconds", "p99", "<", 0.200),
]


def per_second(df: DataFrame, metric: str) -> DataFrame:
    """min, mean and max of one metric per epoch second, as three rows each."""
    agg = (
        df.where(F.col("metric_name") == metric)
        .groupBy(F.col("timestamp").cast("long").alias("timestamp"))
        .agg(
            F.min("metric_value").alias("min_val"),
            F.avg("metric_value").alias("mean_val"),
            F.max("metric_value").alias("max_val"),
        )
    )
    return agg.unpivot(["timestamp"], ["min_val", "mean_val", "max_val"], "stat", "metric_value").withColumn(
        "metric_name", F.lit(metric)
    )


def align_envs(edge: DataFrame, cloud: DataFrame, metric: str, ts: str = "ts", step: int = 1) -> DataFrame:
    """One metric of two runs, downsampled, each in whole seconds from its own start."""
    parts = []
    for name, df in (("Edge", edge), ("Cloud", cloud)):
        points = downsample(df.where(F.col("metric_name") == metric), ts, "metric_value", step)
        points = relative_seconds(points, "bucket", whole=True, name="relative_time")
        parts.append(points.withColumns({"environment": F.lit(name), "metric_name": F.lit(metric)}))
    return parts[0].unionByName(parts[1])


def align_seconds(edge: DataFrame, cloud: DataFrame, metric: str) -> DataFrame:
    """The per-second form of both runs, relative to each run's first second."""
    parts = []
    for name, df in (("Edge", edge), ("Cloud", cloud)):
        points = per_second(df, metric)
        start = points.agg(F.min("timestamp").alias("t")).scalar()
        parts.append(points.withColumns({"relative_time": F.col("timestamp") - start, "environment": F.lit(name)}))
    return parts[0].unionByName(parts[1])


def metric_stats(df: DataFrame, value: str = "metric_value", by: Sequence[str] = ("environment",), *, few_groups: bool = False) -> DataFrame:
    """avg, max, min and median per group."""
    plain = df.groupBy(*by).agg(F.avg(value).alias("avg"), F.max(value).alias("max"), F.min(value).alias("min"))
    mid = exact_quantiles(df, by, value, [0.5]).select(*by, F.col("q")[0].alias("median"))
    return attach(plain, mid, by, few_groups=few_groups)


def metric_names(df: DataFrame) -> DataFrame:
    return df.select("metric_name").distinct()


def metric_totals(
    df: DataFrame,
    errors: str = "kafka_writer_error_count",
    retries: str = "kafka_writer_retries_count",
) -> DataFrame:
    """Total errors and total retries."""

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("metric_name") == name, F.col("metric_value"))), F.lit(0.0))

    return df.agg(total(errors).alias("errors"), total(retries).alias("retries"))


def running_total(
    df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, out: str = "running"
) -> DataFrame:
    """Sum of `value` from the start of the series up to each row."""
    return Ordered(df, by, order).running_sum(F.col(value), out).result()


def check_slo(df: DataFrame, rules: Sequence[tuple[str, str, str, float]] = SLO_RULES) -> DataFrame:
    """Measured value and pass/fail per rule; a metric without samples measures 0."""
    spark = df.sparkSession
    table = spark.createDataFrame(
        [tuple(r) for r in rules], "metric_name string, stat string, op string, limit_value double"
    )
    used = df.where(F.col("metric_name").isin(sorted({r[0] for r in rules})))
    totals = used.groupBy("metric_name").agg(F.sum("metric_value").alias("_count"))
    q = exact_quantiles(used, ["metric_name"], "metric_value", [0.95, 0.99])
    measured = attach(totals, q.drop("n"), ["metric_name"], few_groups=True)
    value = (
        F.when(F.col("stat") == "count", F.col("_count"))
        .when(F.col("stat") == "p95", F.col("q")[0])
        .when(F.col("stat") == "p99", F.col("q")[1])
    )
    passed = (
        F.when(F.col("op") == "==", F.col("measured") == F.col("limit_value"))
        .when(F.col("op") == "<", F.col("measured") < F.col("limit_value"))
        .when(F.col("op") == "<=", F.col("measured") <= F.col("limit_value"))
    )
    return (
        table.join(measured, "metric_name", "left")
        .withColumn("measured", F.coalesce(value, F.lit(0.0)))
        .select("metric_name", "stat", "op", "limit_value", "measured", passed.alias("passed"))
    )


def ack_summary(df: DataFrame, value: str = "ack_latency", lo: float = 0.0, hi: float = 0.95) -> DataFrame:
    """Distribution of acknowledgement latency, before and after the quantile trim."""
    kept = trim_quantiles(df, {value: (lo, hi)})
    return (
        describe(df, value)
        .withColumn("rows", F.lit("all"))
        .unionByName(describe(kept, value).withColumn("rows", F.lit("trimmed")))
    )


def interval_stats(df: DataFrame, by: Sequence[str], ts: str, tie: Sequence[str] = ()) -> DataFrame:
    """Seconds between consecutive messages per robot; population standard deviation."""
    o = Ordered(df.select(*by, ts, *tie), by, [ts, *tie]).lag([ts])
    deltas = o.result().select(*by, seconds_between(ts, f"_prev1.{ts}").alias("_d")).where("_d is not null")
    plain = deltas.groupBy(*by).agg(
        F.count("_d").alias("count"),
        F.min("_d").alias("min"),
        F.max("_d").alias("max"),
        F.avg("_d").alias("mean"),
        F.stddev_pop("_d").alias("std"),
    )
    mid = exact_quantiles(deltas, by, "_d", [0.5]).select(*by, F.col("q")[0].alias("median"))
    return attach(plain, mid, by)


def index_rows(df: DataFrame, order: Sequence[str], name: str = "seq") -> DataFrame:
    """Consecutive row numbers from 0 in the given order, without sorting in one task."""
    return (
        Ordered(df, [], order)
        .running_sum(F.lit(1), name)
        .result()
        .withColumn(name, (F.col(name) - 1).cast("long"))
    )


def replay(
    df: DataFrame,
    seq: str,
    robots: int,
    freq: float,
    start,
    seconds: float | None = None,
    cycles: int | None = None,
) -> DataFrame:
    """The messages a fleet sends: every robot cycles through the dataset rows at `freq` Hz.

    `seq` numbers the rows from 0. Message m of a robot carries row m modulo the
    number of rows, at start + m / freq. The replay lasts some seconds or a number
    of passes over the dataset.
    """
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    messages = F.lit(int(freq * seconds)).cast("long") if seconds is not None else rows * cycles
    turns = F.when(F.col(seq) < messages, F.sequence(F.col(seq), messages - 1, rows))
    first = start if isinstance(start, Column) else F.lit(start)
    at = F.timestamp_micros(micros(first) + F.round(F.col("message") * F.lit(1e6 / freq)).cast("long"))
    return (
        df.where(F.col(seq) < messages)
        .withColumn("message", F.explode(turns))
        .withColumn("robot_id", F.explode(F.sequence(F.lit(0), F.lit(robots - 1))))
        .withColumn("source_timestamp", at)
    )
