"""Counter, gauge and resource queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.timeutil import bucket, relative_seconds
from tidewatch.functions.units import convert_unit
from tidewatch.operators import metrics as met
from tidewatch.plans import views as v
from tidewatch.plans.registry import query
from tidewatch.plans.views import with_

DELTAS = (
    "SELECT *, value - lag(value) OVER w AS diff,"
    " (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w)) / 1e6 AS gap FROM counters"
    " WINDOW w AS (PARTITION BY series ORDER BY timestamp, event_id)"
)
INCREASE = "SELECT *, CASE WHEN diff < 0 THEN value ELSE diff END / CASE WHEN gap > 0 THEN gap END AS rate FROM d"
KINDS = ["view", "click", "signup", "purchase", "error"]
HALF_HOUR = "time_bucket(INTERVAL 30 MINUTE, timestamp)"


def rate(spark, folder, **how):
    return met.counter_rate(
        v.counters(spark, folder), ["series"], "timestamp", "value", tie=["event_id"], **how
    ).select("event_id", "series", "rate")


@query(
    "counter_rate_increase",
    with_("counters", d=DELTAS, r=INCREASE) + "SELECT event_id, series, rate FROM r",
    ["rate"],
)
def counter_rate_increase(spark, folder):
    return rate(spark, folder)


@query(
    "counter_rate_zero_gap",
    with_(
        "counters",
        d="SELECT *, value - lag(value) OVER w AS diff, date_diff('minute', lag(m) OVER w, m) * 60.0::DOUBLE AS gap"
        " FROM (SELECT *, date_trunc('minute', timestamp) AS m FROM counters)"
        " WINDOW w AS (PARTITION BY series ORDER BY m, event_id)",
    )
    + "SELECT event_id, series, CASE WHEN diff < 0 THEN value ELSE diff END"
    " / CASE WHEN gap = 0 THEN 1 ELSE gap END AS rate FROM d",
    ["rate"],
)
def counter_rate_zero_gap(spark, folder):
    df = v.counters(spark, folder).withColumn("timestamp", F.date_trunc("minute", "timestamp"))
    out = met.counter_rate(df, ["series"], "timestamp", "value", zero_gap="one", tie=["event_id"])
    return out.select("event_id", "series", "rate")


@query(
    "counter_rate_drop_reset",
    with_("counters", d=DELTAS) + "SELECT event_id, series, diff / gap AS rate FROM d WHERE diff >= 0 AND gap > 0",
    ["rate"],
)
def counter_rate_drop_reset(spark, folder):
    return rate(spark, folder, policy="drop_reset", zero_gap="drop")


@query(
    "counter_rate_drop_nonpositive",
    with_("counters", d=DELTAS)
    + "SELECT event_id, series, diff / gap * 100 AS rate FROM d WHERE diff > 0 AND gap > 0",
    ["rate"],
)
def counter_rate_drop_nonpositive(spark, folder):
    df = rate(spark, folder, policy="drop_nonpositive", zero_gap="drop")
    return df.withColumn("rate", convert_unit("rate", "cpu_to_percent"))


@query(
    "counter_delta",
    with_("counters", d=DELTAS)
    + "SELECT event_id, series, CASE WHEN diff < 0 THEN value ELSE diff END AS rate FROM d",
    ["rate"],
)
def counter_delta(spark, folder):
    return rate(spark, folder, per_second=False)


@query(
    "io_rate",
    with_(
        "counters",
        c="SELECT node, timestamp, event_id, CAST(sum(CAST(round(raw * 100) AS BIGINT)) OVER"
        " (PARTITION BY node, CAST(timestamp AS DATE) ORDER BY timestamp, event_id) AS DOUBLE) AS value FROM samples",
        d="SELECT *, value - lag(value) OVER w AS diff,"
        " (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w)) / 1e6 AS gap FROM c"
        " WINDOW w AS (PARTITION BY node ORDER BY timestamp, event_id)",
    )
    + "SELECT event_id, node, CASE WHEN diff < 0 THEN value ELSE diff END / CASE WHEN gap > 0 THEN gap END AS rate"
    " FROM d",
    ["rate"],
)
def io_rate(spark, folder):
    df = v.daily_counter(v.samples(spark, folder), "node")
    return met.counter_rate(df, ["node"], "timestamp", "value", tie=["event_id"]).select("event_id", "node", "rate")


@query(
    "rolling_mean3",
    with_("samples") + "SELECT event_id, series, avg(raw) OVER (PARTITION BY series ORDER BY timestamp, event_id"
    " ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS smoothed FROM samples",
    ["smoothed"],
)
def rolling_mean3(spark, folder):
    df = met.rolling_mean(v.samples(spark, folder), ["series"], ["timestamp", "event_id"], "raw")
    return df.select("event_id", "series", "smoothed")


@query(
    "resample_mean",
    with_("samples")
    + "SELECT series, node, time_bucket(INTERVAL 30 SECOND, timestamp) AS bucket, avg(raw) AS raw"
    " FROM samples GROUP BY 1, 2, 3",
    ["raw"],
)
def resample_mean(spark, folder):
    return met.resample(v.samples(spark, folder), "timestamp", 30, ["series", "node"], "raw")


FILLED = {
    "b": f"SELECT series, node, {HALF_HOUR} AS bucket, avg(raw) AS raw FROM samples GROUP BY 1, 2, 3",
    "e": "SELECT series, node, unnest(generate_series(min(bucket), max(bucket), INTERVAL 30 MINUTE)) AS bucket"
    " FROM b GROUP BY 1, 2",
}


@query(
    "resample_gap_fill",
    with_("samples", **FILLED)
    + "SELECT e.series, e.node, e.bucket, b.raw FROM e LEFT JOIN b ON e.series = b.series AND e.node = b.node"
    " AND e.bucket = b.bucket",
    ["raw"],
)
def resample_gap_fill(spark, folder):
    return met.resample(v.samples(spark, folder), "timestamp", 1800, ["series", "node"], "raw", fill=True)


@query(
    "node_total_pivot",
    with_("samples", b=FILLED["b"])
    + "SELECT bucket, "
    + ", ".join(f"coalesce(sum(raw) FILTER (node = '{n}'), 0) AS {n}" for n in v.NODES)
    + " FROM b GROUP BY bucket",
    v.NODES,
)
def node_total_pivot(spark, folder):
    df = met.resample(v.samples(spark, folder), "timestamp", 1800, ["series", "node"], "raw")
    return met.totals_wide(df, "bucket", "node", v.NODES, "raw")


@query(
    "series_pivot",
    with_("samples", m="SELECT min(timestamp) AS t FROM samples")
    + f"SELECT (epoch_us({HALF_HOUR}) - epoch_us(time_bucket(INTERVAL 30 MINUTE, t))) / 1e6 AS relative_s, "
    + ", ".join(f"coalesce(avg(raw) FILTER (series = '{k}'), 0) AS {k}" for k in KINDS)
    + " FROM samples, m GROUP BY 1",
    ["relative_s", *KINDS],
)
def series_pivot(spark, folder):
    df = v.samples(spark, folder).withColumn("bucket", bucket("timestamp", 1800))
    df = relative_seconds(df, "bucket")
    return met.totals_wide(df, "relative_s", "series", KINDS, "raw", "mean")


@query(
    "top_series",
    with_("ev") + "SELECT user_id, avg(value) AS mean, max(value) AS max FROM ev GROUP BY 1"
    " ORDER BY mean DESC, user_id LIMIT 5",
    ["mean", "max"],
)
def top_series(spark, folder):
    return met.top_series(v.events(spark, folder), "user_id", "value")


@query(
    "top_series_by_node",
    with_(
        "ev",
        a="SELECT user_id % 3 AS node, user_id, avg(value) AS mean, max(value) AS max FROM ev GROUP BY 1, 2",
        r="SELECT *, row_number() OVER (PARTITION BY node ORDER BY max DESC, user_id) AS rn FROM a",
    )
    + "SELECT node, user_id, mean, max FROM r WHERE rn <= 5",
    ["mean", "max"],
)
def top_series_by_node(spark, folder):
    df = v.events(spark, folder).withColumn("node", F.col("user_id") % 3)
    return met.top_series(df, "user_id", "value", rank="max", within=["node"])


SMOOTH_PODS = {
    "p": "SELECT timestamp, pod, container, sum(value) AS value FROM ccounters GROUP BY 1, 2, 3",
    "d": "SELECT *, value - lag(value) OVER w AS diff,"
    " (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w)) / 1e6 AS gap FROM p WHERE container IS NOT NULL"
    " WINDOW w AS (PARTITION BY pod ORDER BY timestamp, container)",
}


@query(
    "preagg_rate",
    with_("ccounters", **SMOOTH_PODS)
    + "SELECT pod, timestamp, diff / gap AS rate FROM d WHERE diff >= 0 AND gap > 0",
    ["rate"],
)
def preagg_rate(spark, folder):
    df = met.preaggregate(v.container_counters(spark, folder), ["timestamp", "pod", "container"], "value")
    out = met.counter_rate(
        df.dropna(subset=["container"]),
        ["pod"],
        "timestamp",
        "value",
        policy="drop_reset",
        zero_gap="drop",
        tie=["container"],
    )
    return out.select("pod", "timestamp", "rate")


@query(
    "throughput_minute",
    with_("counters", d=DELTAS, r=INCREASE)
    + "SELECT time_bucket(INTERVAL 1 MINUTE, timestamp) AS bucket, sum(rate / 1048576) AS total FROM r GROUP BY 1",
    ["total"],
)
def throughput_minute(spark, folder):
    df = met.counter_rate(v.counters(spark, folder), ["series"], "timestamp", "value", tie=["event_id"])
    df = df.withColumn("rate", convert_unit("rate", "bytes_to_mib"))
    return met.resample_total(df, "timestamp", 60, [], "rate")


@query(
    "throughput_mean_then_sum",
    with_("samples", b=FILLED["b"]) + "SELECT bucket, sum(raw) AS total FROM b GROUP BY 1",
    ["total"],
)
def throughput_mean_then_sum(spark, folder):
    return met.resample_total(
        v.samples(spark, folder), "timestamp", 1800, ["series", "node"], "raw", "mean_then_sum"
    )


@query(
    "limit_lookup",
    with_("samples", "limits")
    + "SELECT event_id, samples.node, cpu_limit, mem_limit, least(raw, cpu_limit) AS used"
    " FROM samples LEFT JOIN limits ON samples.node = limits.node",
    ["cpu_limit", "mem_limit", "used"],
)
def limit_lookup(spark, folder):
    df = met.with_limits(v.samples(spark, folder), v.limits(spark))
    used = F.least("raw", "cpu_limit").alias("used")
    return df.select("event_id", "node", "cpu_limit", "mem_limit", used)


@query(
    "gauge_series",
    with_("samples")
    + "SELECT series, time_bucket(INTERVAL 1 MINUTE, timestamp) AS bucket, avg(raw) AS mean, min(raw) AS min,"
    " max(raw) AS max FROM samples GROUP BY 1, 2",
    ["mean", "min", "max"],
)
def gauge_series(spark, folder):
    return met.gauge_series(v.samples(spark, folder), "timestamp", "series", "raw", 60)


@query(
    "offset_truncation",
    with_("counters", d="SELECT *, lag(value) OVER (PARTITION BY series ORDER BY timestamp, event_id) AS prior FROM counters")
    + "SELECT series, timestamp, prior, value AS current, prior - value AS lost FROM d WHERE value < prior",
    ["prior", "current", "lost"],
)
def offset_truncation(spark, folder):
    return met.offset_truncations(v.counters(spark, folder), ["series"], "timestamp", "value", ["event_id"])


@query(
    "offset_truncation_report",
    with_(
        "counters",
        d="SELECT *, lag(value) OVER (PARTITION BY series, node ORDER BY timestamp, event_id) AS prior FROM counters",
    )
    + "SELECT series, node, count(*) FILTER (value < prior) AS truncations,"
    " coalesce(sum(prior - value) FILTER (value < prior), 0) AS lost FROM d GROUP BY 1, 2",
    ["lost"],
)
def offset_truncation_report(spark, folder):
    return met.truncation_report(v.counters(spark, folder), ["series", "node"], "timestamp", "value", ["event_id"])


@query(
    "host_usage",
    with_("ev")
    + "SELECT event_id, CAST(100 - k AS DOUBLE) AS cpu_usage, CASE WHEN event_type = 'error' THEN 0 ELSE"
    " (16000000 - (k * 1000 + k * 100 + floor(value))) / 16000000.0::DOUBLE * 100 END AS mem_usage FROM ev",
    ["cpu_usage", "mem_usage"],
)
def host_usage(spark, folder):
    df = v.events(spark, folder).select(
        "event_id",
        F.col("k").alias("id"),
        (F.col("k") * 1000).alias("free"),
        (F.col("k") * 100).alias("buff"),
        F.floor("value").alias("cache"),
        F.when(F.col("event_type") == "error", 0).otherwise(16_000_000).alias("total_mem_kb"),
    )
    return met.host_usage(df).select("event_id", "cpu_usage", "mem_usage")


CPU = {
    "d": "SELECT *, value - lag(value) OVER w AS diff,"
    " (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w)) / 1e6 AS gap FROM ccounters"
    " WHERE container IS NOT NULL WINDOW w AS (PARTITION BY environment, id ORDER BY timestamp)",
    "r": "SELECT *, diff / gap * 100 AS rate FROM d WHERE diff > 0 AND gap > 0",
    "s": "SELECT *, avg(rate) OVER (PARTITION BY environment, pod ORDER BY id, timestamp ROWS 2 PRECEDING) AS u FROM r",
}


@query(
    "node_resources",
    with_(
        "ccounters",
        "cmem",
        **CPU,
        cb="SELECT environment, node, pod, time_bucket(INTERVAL 40 SECOND, timestamp) AS bucket, avg(u) AS u"
        " FROM s GROUP BY 1, 2, 3, 4",
        cn="SELECT environment, bucket, node, sum(u) AS u FROM cb GROUP BY 1, 2, 3",
        ms="SELECT *, avg(value / 1073741824) OVER (PARTITION BY environment, pod ORDER BY timestamp, id"
        " ROWS 2 PRECEDING) AS u FROM cmem WHERE container IS NOT NULL",
        mb="SELECT environment, node, pod, id, time_bucket(INTERVAL 40 SECOND, timestamp) AS bucket, avg(u) AS u"
        " FROM ms GROUP BY 1, 2, 3, 4, 5",
        mn="SELECT environment, bucket, node, sum(u) AS u FROM mb GROUP BY 1, 2, 3",
    )
    + "SELECT coalesce(cn.environment, mn.environment) AS environment, coalesce(cn.bucket, mn.bucket) AS bucket,"
    " coalesce(cn.node, mn.node) AS node, coalesce(cn.u, 0) AS cpu_percent, coalesce(mn.u, 0) AS memory_gib"
    " FROM cn FULL JOIN mn ON cn.environment = mn.environment AND cn.bucket = mn.bucket AND cn.node = mn.node",
    ["cpu_percent", "memory_gib"],
)
def node_resources(spark, folder):
    return met.node_resources(v.container_counters(spark, folder), v.container_memory(spark, folder))


# Pods shortened as in the pod charts.
SHORT = (
    "CASE pod WHEN 'msg-bus-0' THEN 'bus-0' WHEN 'msg-bus-1-fv5kx' THEN 'bus-1'"
    " WHEN 'app-driver' THEN 'app' ELSE pod END"
)


def _pod_usage_sql(limit: str) -> str:
    return (
        f"SELECT b.environment, b.node, pod, bucket,"
        f" (epoch_us(bucket) - epoch_us(min(bucket) OVER (PARTITION BY b.environment))) / 1e6 AS relative_s,"
        f" u AS usage, {limit} AS usage_limit FROM b LEFT JOIN limits ON b.node = limits.node"
    )


@query(
    "pod_usage_cpu",
    with_(
        "ccounters",
        "limits",
        d=CPU["d"],
        r="SELECT * REPLACE (" + SHORT + " AS pod), CASE WHEN diff < 0 THEN value ELSE diff END"
        " / CASE WHEN gap = 0 THEN 1 ELSE gap END * 100 AS rate FROM d WHERE diff IS NOT NULL",
        s=CPU["s"],
        b="SELECT environment, node, pod, time_bucket(INTERVAL 30 SECOND, timestamp) AS bucket, avg(u) AS u"
        " FROM s GROUP BY 1, 2, 3, 4",
    )
    + _pod_usage_sql("cpu_limit"),
    ["relative_s", "usage", "usage_limit"],
)
def pod_usage_cpu(spark, folder):
    return met.pod_usage(v.container_counters(spark, folder), "cpu", v.limits(spark), names=v.SHORT_NAMES)


@query(
    "pod_usage_memory",
    with_(
        "cmem",
        "limits",
        b="SELECT environment, node, " + SHORT + " AS pod, time_bucket(INTERVAL 30 SECOND, timestamp) AS bucket,"
        " avg(value / 1073741824) AS u FROM cmem WHERE container IS NOT NULL GROUP BY 1, 2, 3, 4",
    )
    + _pod_usage_sql("mem_limit"),
    ["relative_s", "usage", "usage_limit"],
)
def pod_usage_memory(spark, folder):
    return met.pod_usage(v.container_memory(spark, folder), "memory", v.limits(spark), names=v.SHORT_NAMES)


def _rate_sql(name: str, src: str, factor: str = "", tie: str = "container") -> str:
    """Smoothed reset-free rate per pod of the samples in `src`."""
    return (
        f"SELECT '{name}' AS series, pod, timestamp, avg(rate) OVER (PARTITION BY pod ORDER BY timestamp, {tie}"
        f" ROWS 2 PRECEDING){factor} AS value FROM (SELECT *, diff / gap AS rate FROM (SELECT *,"
        f" value - lag(value) OVER w AS diff, (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w)) / 1e6 AS gap"
        f" FROM ({src}) WHERE container IS NOT NULL"
        f" WINDOW w AS (PARTITION BY pod ORDER BY timestamp, {tie})) WHERE diff >= 0 AND gap > 0)"
    )


def _sum_sql(where: str = "TRUE") -> str:
    return f"SELECT timestamp, pod, container, sum(value) AS value FROM ccounters WHERE {where} GROUP BY 1, 2, 3"


def _cpu_sql(order: str, keep: str) -> str:
    return (
        f"SELECT 'cpu_percent' AS series, pod, timestamp, u AS value FROM (SELECT *, avg(rate) OVER"
        f" (PARTITION BY pod ORDER BY {order} ROWS 2 PRECEDING) AS u FROM (SELECT *, diff / gap * 100 AS rate"
        f" FROM (SELECT *, value - lag(value) OVER w AS diff,"
        f" (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w)) / 1e6 AS gap FROM ccounters"
        f" WHERE container IS NOT NULL WINDOW w AS (PARTITION BY id ORDER BY timestamp))"
        f" WHERE diff > 0 AND gap > 0)) WHERE {keep}"
    )


@query(
    "store_panel",
    with_("ccounters")
    + " UNION ALL ".join(
        [
            _rate_sql("requests", _sum_sql()),
            _rate_sql("errors", _sum_sql("node = 'w0'")),
            _rate_sql("waiting", _sum_sql("node = 'w1'")),
            _rate_sql("sent_kib", "SELECT * FROM ccounters WHERE node = 'w2'", " / 1024", "container, id"),
            _rate_sql("received_kib", "SELECT * FROM ccounters WHERE node <> 'w2'", " / 1024", "container, id"),
            _cpu_sql("id, timestamp", "pod LIKE 'blob-%'"),
        ]
    ),
    ["value"],
)
def store_panel(spark, folder):
    c = v.container_counters(spark, folder)
    return met.store_panel(
        c,
        c.where("node = 'w0'"),
        c.where("node = 'w1'"),
        c.where("node = 'w2'"),
        c.where("node <> 'w2'"),
        c,
        v.SERVICES["Store"],
    )


@query(
    "broker_panel",
    with_("ccounters")
    + " UNION ALL ".join(
        [
            _rate_sql("bytes_in", _sum_sql("topic = 'orders'")),
            _rate_sql("bytes_out", _sum_sql("topic = 'orders' AND node = 'w1'")),
            _rate_sql("requests", _sum_sql()),
            _rate_sql("errors", _sum_sql("node = 'w0'")),
            _rate_sql("messages", "SELECT * FROM ccounters WHERE topic = 'orders'", "", "container, id"),
            _cpu_sql("timestamp, id", "pod LIKE '%-bus-%' AND container = 'broker'"),
        ]
    ),
    ["value"],
)
def broker_panel(spark, folder):
    c = v.container_counters(spark, folder)
    return met.broker_panel(c, c.where("node = 'w1'"), c, c.where("node = 'w0'"), c, c, topic=v.TOPIC, words=["-bus-"], container="broker")


