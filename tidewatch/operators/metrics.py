"""Counters, gauges and resource usage (MET)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.naming import short_name, starts_with_any
from tidewatch.functions.timeutil import bucket, seconds_between
from tidewatch.functions.units import FACTORS
from tidewatch.operators.joins import attach
from tidewatch.operators.ordered import Ordered


def _rate(
    o: Ordered, ts: str, value: str, policy: str, zero_gap: str, per_second: bool, out: str
) -> Ordered:
    """Rate columns on an ordered frame, dropping rows only after the lag."""
    if policy not in ("as_increase", "drop_reset", "drop_nonpositive"):
        raise ValueError(f"unknown reset policy: {policy}")
    if zero_gap not in ("null", "one", "drop"):
        raise ValueError(f"unknown zero-gap rule: {zero_gap}")

    def change(df: DataFrame) -> DataFrame:
        diff = F.col(value) - F.col(f"_prev1.{value}")
        gap = seconds_between(ts, f"_prev1.{ts}")
        df = df.withColumn("_diff", diff).withColumn("_gap", gap)
        if policy == "as_increase":
            increase = F.when(F.col("_diff") < 0, F.col(value)).otherwise(F.col("_diff"))
        else:
            increase = F.col("_diff")
            df = df.where(F.col("_diff") >= 0 if policy == "drop_reset" else F.col("_diff") > 0)
        if not per_second:
            return df.withColumn(out, increase).drop("_diff", "_gap", "_prev1")
        if zero_gap == "one":
            seconds = F.when(F.col("_gap") == 0, F.lit(1.0)).otherwise(F.col("_gap"))
        else:
            seconds = F.when(F.col("_gap") > 0, F.col("_gap"))
            if zero_gap == "drop":
                df = df.where("_gap > 0")
        return df.withColumn(out, increase / seconds).drop("_diff", "_gap", "_prev1")

    return o.lag([ts, value]).then(change)


def counter_rate(
    df: DataFrame,
    by: Sequence[str],
    ts: str,
    value: str,
    *,
    policy: str = "as_increase",
    zero_gap: str = "null",
    per_second: bool = True,
    tie: Sequence[str] = (),
    out: str = "rate",
) -> DataFrame:
    """Increase of a counter per second and series.

    On a reset (the value falls) `as_increase` counts the new value itself,
    `drop_reset` drops the sample, `drop_nonpositive` also drops unchanged ones.
    Two samples at one time: the rate is null, counts the gap as one second, or
    the sample is dropped. The first sample has no rate.
    """
    o = Ordered(df, by, [ts, *tie])
    return _rate(o, ts, value, policy, zero_gap, per_second, out).result()


def _rolling(o: Ordered, value: str, n: int, out: str) -> Ordered:
    def mean(df: DataFrame) -> DataFrame:
        seen = [F.col(value)] + [F.col(f"_prev{i}.{value}") for i in range(1, n)]
        total, count = F.lit(0.0), F.lit(0)
        for c in seen:
            total = total + F.coalesce(c, F.lit(0.0))
            count = count + F.when(c.isNotNull(), 1).otherwise(0)
        smooth = F.when(count > 0, total / count)
        return df.withColumn(out, smooth).drop(*[f"_prev{i}" for i in range(1, n)])

    return o.lag([value], n - 1).then(mean)


def rolling_mean(
    df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, n: int = 3, out: str = "smoothed"
) -> DataFrame:
    """Mean of the row and up to n-1 rows before it in the series, nulls skipped."""
    return _rolling(Ordered(df, by, order), value, n, out).result()


def resample(
    df: DataFrame,
    ts: str,
    step: int,
    by: Sequence[str],
    value: str,
    agg: str = "mean",
    fill: bool = False,
) -> DataFrame:
    """Mean or sum per series and fixed interval, at `bucket`.

    `fill` adds the empty intervals inside each series' own span with a null value.
    """
    fn = {"mean": F.avg, "sum": F.sum, "max": F.max}[agg]
    agged = df.groupBy(*by, bucket(ts, step).alias("bucket")).agg(fn(value).alias(value))
    if not fill:
        return agged
    every = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(step)))
    spine = (
        agged.groupBy(*by)
        .agg(F.min("bucket").alias("_a"), F.max("bucket").alias("_b"))
        .select(*by, F.explode(F.sequence("_a", "_b", every)).alias("bucket"))
    )
    return attach(spine, agged, [*by, "bucket"])


def resample_total(df: DataFrame, ts: str, step: int, by: Sequence[str], value: str, mode: str = "sum") -> DataFrame:
    """Total over all series per interval.

    `sum` adds every sample, so it grows with the scrape frequency;
    `mean_then_sum` adds one mean per series.
    """
    if mode == "sum":
        return df.groupBy(bucket(ts, step).alias("bucket")).agg(F.sum(value).alias("total"))
    if mode == "mean_then_sum":
        return resample(df, ts, step, by, value).groupBy("bucket").agg(F.sum(value).alias("total"))
    raise ValueError(f"unknown total: {mode}")


def totals_wide(
    df: DataFrame, time: str, col: str, col_values: Sequence[str], value: str, agg: str = "sum"
) -> DataFrame:
    """One row per time, one column per label value, 0 where there is no sample."""
    fn = {"sum": F.sum, "mean": F.avg}[agg]
    return df.groupBy(time).pivot(col, list(col_values)).agg(fn(value)).na.fill(0.0, list(col_values))


def top_series(
    df: DataFrame, by: str, value: str, n: int = 5, rank: str = "mean", within: Sequence[str] = ()
) -> DataFrame:
    """The n series with the largest mean (or maximum), per `within` group."""
    stats = df.groupBy(*within, by).agg(F.avg(value).alias("mean"), F.max(value).alias("max"))
    if not within:
        return stats.orderBy(F.desc(rank), by).limit(n)
    w = Window.partitionBy(*within).orderBy(F.desc(rank), by)
    return stats.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def preaggregate(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Sum label sets that share (time, pod, container) before taking rates."""
    return df.groupBy(*keys).agg(F.sum(value).alias(value))


def with_limits(df: DataFrame, limits: DataFrame, on: str = "node") -> DataFrame:
    """Limit columns by node; the table has one row per machine of the cluster."""
    return attach(df, limits, [on], few_groups=True)


def gauge_series(df: DataFrame, ts: str, label: str, value: str, step: int) -> DataFrame:
    """Mean, min and max of a gauge per label and interval."""
    return df.groupBy(label, bucket(ts, step).alias("bucket")).agg(
        F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")
    )


def offset_truncations(df: DataFrame, by: Sequence[str], ts: str, value: str, tie: Sequence[str] = ()):
    """Samples where an offset fell: time, offset before and after, lost count."""
    o = Ordered(df, by, [ts, *tie]).lag([value])
    prior = F.col(f"_prev1.{value}")
    return (
        o.result()
        .where(F.col(value) < prior)
        .select(*by, ts, prior.alias("prior"), F.col(value).alias("current"), (prior - F.col(value)).alias("lost"))
    )


def truncation_report(df: DataFrame, by: Sequence[str], ts: str, value: str, tie: Sequence[str] = ()):
    """One row per partition, also for those that never lost an offset."""
    o = Ordered(df, by, [ts, *tie]).lag([value])
    drop = F.col(f"_prev1.{value}") - F.col(value)
    return (
        o.result()
        .groupBy(*by)
        .agg(
            F.count_if(drop > 0).alias("truncations"),
            F.coalesce(F.sum(F.when(drop > 0, drop)), F.lit(0.0)).alias("lost"),
        )
    )


def host_usage(df: DataFrame, total_mem_kb: Column | str = "total_mem_kb") -> DataFrame:
    """CPU percent in use and memory percent outside buffers and cache."""
    total = F.col(total_mem_kb) if isinstance(total_mem_kb, str) else total_mem_kb
    used = total - (F.col("free") + F.col("buff") + F.col("cache"))
    return df.withColumns(
        {
            "cpu_usage": (100 - F.col("id")).cast("double"),
            "mem_usage": F.when(total > 0, used / total * 100).otherwise(F.lit(0.0)),
        }
    )


def _cpu_smoothed(
    df: DataFrame, policy: str, zero_gap: str, keep: Sequence[str], order: Sequence[str] = ("id", "timestamp")
) -> DataFrame:
    """CPU percent per container series, smoothed over three samples of the pod."""
    samples = df.dropna(subset=["container"])
    cpu = counter_rate(
        samples, ["environment", "id"], "timestamp", "value", policy=policy, zero_gap=zero_gap
    )
    cpu = cpu.withColumn("rate", F.col("rate") * FACTORS["cpu_to_percent"]).dropna(subset=["rate"])
    cpu = cpu.select(*keep, "rate")
    return rolling_mean(cpu, ["environment", "pod"], order, "rate", out="usage")


def node_usage(usage: DataFrame, step: int, by: Sequence[str] = ("node", "pod")) -> DataFrame:
    """Mean per series and interval, then the sum per node."""
    mean = resample(usage, "timestamp", step, ["environment", *by], "usage")
    return mean.groupBy("environment", "bucket", "node").agg(F.sum("usage").alias("usage"))


def cpu_usage(
    df: DataFrame, *, policy: str = "as_increase", zero_gap: str = "one", names: Mapping[str, str] | None = None
) -> DataFrame:
    """Smoothed CPU percent per sample: environment, timestamp, id, pod, node, usage.

    Series of one pod are smoothed together, one container after the other. With `names`
    pods go by their short names.
    """
    if names is not None:
        df = df.withColumn("pod", short_name("pod", names))
    keep = ["environment", "timestamp", "id", "pod", "node"]
    return _cpu_smoothed(df, policy, zero_gap, keep).drop("rate")


def memory_usage(df: DataFrame, *, smooth: bool = False, names: Mapping[str, str] | None = None) -> DataFrame:
    """Memory GiB per sample, optionally smoothed over three samples of the pod."""
    mem = df.dropna(subset=["container"]).withColumn("usage", F.col("value") * FACTORS["bytes_to_gib"])
    if names is not None:
        mem = mem.withColumn("pod", short_name("pod", names))
    keep = ["environment", "timestamp", "id", "pod", "node", "usage"]
    mem = mem.select(*keep)
    if not smooth:
        return mem
    out = rolling_mean(mem, ["environment", "pod"], ["timestamp", "id"], "usage", out="_s")
    return out.withColumn("usage", F.col("_s")).drop("_s")


def pod_usage(df: DataFrame, kind: str, limits: DataFrame, step: int = 30, *, names: Mapping[str, str]) -> DataFrame:
    """CPU percent or memory GiB per pod and interval, with time since start and the node's limit."""
    usage = cpu_usage(df, names=names) if kind == "cpu" else memory_usage(df, names=names)
    series = resample(usage, "timestamp", step, ["environment", "node", "pod"], "usage")
    starts = series.groupBy("environment").agg(F.min("bucket").alias("_start"))
    series = attach(series, starts, ["environment"], few_groups=True)
    limit = "cpu_limit" if kind == "cpu" else "mem_limit"
    return with_limits(series, limits.select("node", F.col(limit).alias("usage_limit"))).select(
        "environment",
        "node",
        "pod",
        "bucket",
        seconds_between("bucket", "_start").alias("relative_s"),
        "usage",
        "usage_limit",
    )


def node_resources(cpu: DataFrame, mem: DataFrame, step: int = 40) -> DataFrame:
    """CPU percent and memory GiB per environment, interval and node, 0 where one is missing."""
    cpu_node = node_usage(cpu_usage(cpu, policy="drop_nonpositive", zero_gap="drop"), step)
    mem_node = node_usage(memory_usage(mem, smooth=True), step, ["node", "pod", "id"])
    both = cpu_node.withColumn("kind", F.lit("cpu_percent")).unionByName(
        mem_node.withColumn("kind", F.lit("memory_gib"))
    )
    return (
        both.groupBy("environment", "bucket", "node")
        .pivot("kind", ["cpu_percent", "memory_gib"])
        .agg(F.sum("usage"))
        .na.fill(0.0, ["cpu_percent", "memory_gib"])
    )


def smoothed_rate(df: DataFrame, by: Sequence[str] = ("pod",), factor: float = 1.0) -> DataFrame:
    """Counter rate without resets, smoothed over three kept samples: by, timestamp, rate."""
    samples = df.dropna(subset=["container"])
    extra = [c for c in ("container", "id") if c in df.columns]
    o = Ordered(samples, by, ["timestamp", *extra])
    o = _rate(o, "timestamp", "value", "drop_reset", "drop", True, "_r")
    o = _rolling(o, "_r", 3, "rate")
    return o.result().select(*by, "timestamp", (F.col("rate") * factor).alias("rate"))


def _summed(df: DataFrame) -> DataFrame:
    return preaggregate(df, ["timestamp", "pod", "container"], "value")


def _panel(parts: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in parts.items():
        part = df.select(F.lit(name).alias("series"), "pod", "timestamp", F.col("rate").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def _panel_cpu(df: DataFrame, keep: Column, order: Sequence[str]) -> DataFrame:
    cpu = _cpu_smoothed(
        df.withColumn("environment", F.lit("")),
        "drop_nonpositive",
        "drop",
        ["environment", "timestamp", "id", "pod", "container"],
        order,
    )
    return cpu.where(keep).select("pod", "timestamp", F.col("usage").alias("rate"))


def store_panel(
    requests: DataFrame,
    errors: DataFrame,
    waiting: DataFrame,
    sent: DataFrame,
    received: DataFrame,
    cpu: DataFrame,
    prefixes: Sequence[str],
) -> DataFrame:
    """Object-store panel: request rates, traffic in KiB/s and CPU of the store's pods."""
    kib = FACTORS["bytes_to_kib"]
    return _panel(
        {
            "requests": smoothed_rate(_summed(requests)),
            "errors": smoothed_rate(_summed(errors)),
            "waiting": smoothed_rate(_summed(waiting)),
            "sent_kib": smoothed_rate(sent, factor=kib),
            "received_kib": smoothed_rate(received, factor=kib),
            "cpu_percent": _panel_cpu(cpu, starts_with_any("pod", prefixes), ["id", "timestamp"]),
        }
    )


def broker_panel(
    bytes_in: DataFrame,
    bytes_out: DataFrame,
    requests: DataFrame,
    errors: DataFrame,
    messages: DataFrame,
    cpu: DataFrame,
    *,
    topic: str,
    words: Sequence[str],
    container: str,
) -> DataFrame:
    """Broker panel: requests, one topic's traffic and messages, CPU of the broker container
    in pods whose name has one of `words`."""
    on_topic = F.col("topic") == topic
    named = F.lit(False)
    for w in words:
        named = named | F.lower("pod").contains(w)
    return _panel(
        {
            "bytes_in": smoothed_rate(_summed(bytes_in.where(on_topic))),
            "bytes_out": smoothed_rate(_summed(bytes_out.where(on_topic))),
            "requests": smoothed_rate(_summed(requests)),
            "errors": smoothed_rate(_summed(errors)),
            "messages": smoothed_rate(messages.where(on_topic)),
            "cpu_percent": _panel_cpu(cpu, named & (F.col("container") == container), ["timestamp", "id"]),
        }
    )


