"""Latency, filter and time queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidewatch.functions import timeutil as tm
from tidewatch.operators import filters as flt
from tidewatch.operators import latency as lat
from tidewatch.plans import views as v
from tidewatch.plans.registry import query
from tidewatch.plans.views import with_

STAGE_COLS = ["source_broker_latency", "broker_landing_latency", "total_latency"]
Q = "quantile_cont(latency, {})"
SUMMARY_SQL = (
    "SELECT stage, environment, round({q50} * 1000, 1) AS median_ms,"
    " round(({q75} - {q25}) * 1000, 1) AS iqr_ms, round({q95} * 1000, 1) AS p95_ms"
    " FROM lng GROUP BY stage, environment"
).format(q25=Q.format(0.25), q50=Q.format(0.5), q75=Q.format(0.75), q95=Q.format(0.95))


def long(spark, folder):
    return lat.latency_long(v.latencies(spark, folder))


@query(
    "latency_stages",
    with_("lats")
    + "SELECT order_id, part, environment, source_broker_latency, broker_landing_latency, total_latency FROM lats",
    STAGE_COLS,
)
def latency_stages(spark, folder):
    return v.latencies(spark, folder).select("order_id", "part", "environment", *STAGE_COLS)


@query(
    "latency_landing_only",
    with_("lats") + "SELECT environment, sum(broker_landing_latency) AS total_s, count(*) AS messages"
    " FROM lats GROUP BY environment",
    ["total_s"],
)
def latency_landing_only(spark, folder):
    df = lat.stage_latencies(v.pings(spark, folder), None, "broker_ts", "landing_ts")
    return df.groupBy("environment").agg(
        F.sum("broker_landing_latency").alias("total_s"), F.count(F.lit(1)).alias("messages")
    )


@query(
    "latency_long",
    with_("lng") + "SELECT environment, stage, stage_order, latency FROM lng",
    ["latency"],
)
def latency_long(spark, folder):
    return long(spark, folder)


@query("latency_summary_ms", with_("lng") + SUMMARY_SQL, ["median_ms", "iqr_ms", "p95_ms"])
def latency_summary_ms(spark, folder):
    return lat.latency_summary(long(spark, folder))


@query(
    "latency_summary_pivot",
    with_("lng", s=SUMMARY_SQL)
    + "SELECT stage, "
    + ", ".join(
        f"max(CASE WHEN environment = '{e}' THEN {s}_ms END) AS {s}_{e.lower()}_ms"
        for s in ("median", "iqr", "p95")
        for e in ("Edge", "Cloud")
    )
    + " FROM s GROUP BY stage",
    [f"{s}_{e}_ms" for s in ("median", "iqr", "p95") for e in ("edge", "cloud")],
)
def latency_summary_pivot(spark, folder):
    return lat.latency_summary_wide(lat.latency_summary(long(spark, folder)))


@query(
    "latency_summary_bars",
    with_("lng", s=SUMMARY_SQL)
    + "SELECT stage, "
    + ", ".join(
        f"coalesce(max(CASE WHEN environment = '{e}' THEN {s}_ms END), 0) AS {s}_{e.lower()}_ms"
        for s in ("median", "p95")
        for e in ("Edge", "Cloud")
    )
    + " FROM s GROUP BY stage",
    [f"{s}_{e}_ms" for s in ("median", "p95") for e in ("edge", "cloud")],
)
def latency_summary_bars(spark, folder):
    return lat.latency_summary_wide(lat.latency_summary(long(spark, folder)), stats=["median_ms", "p95_ms"], fill=0.0)


@query(
    "latency_report",
    with_("lng", s=SUMMARY_SQL)
    + "SELECT stage, environment, printf('%s latency in %s: median %.1f ms, IQR %.1f ms, 95th percentile %.1f ms',"
    " stage, environment, median_ms, iqr_ms, p95_ms) AS sentence FROM s",
)
def latency_report(spark, folder):
    return lat.report_sentences(lat.latency_summary(long(spark, folder)))


@query(
    "latency_value",
    with_("lng", s=SUMMARY_SQL) + "SELECT p95_ms AS value FROM s WHERE stage = 'Total' AND environment = 'Cloud'",
    ["value"],
)
def latency_value(spark, folder):
    return lat.summary_value(lat.latency_summary(long(spark, folder)), "Total", "p95_ms", "Cloud")


@query(
    "latency_env_stats",
    with_("lats")
    + "SELECT environment, min(total_latency) AS min, max(total_latency) AS max, avg(total_latency) AS mean,"
    " stddev_samp(total_latency) AS std, median(total_latency) AS median FROM lats GROUP BY environment",
    ["min", "max", "mean", "std", "median"],
)
def latency_env_stats(spark, folder):
    return lat.env_stats(v.latencies(spark, folder), "total_latency")


def _describe_sql(col: str, src: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return (
        f"SELECT {keys}count({col}) AS count, avg({col}) AS mean, stddev_samp({col}) AS std, min({col}) AS min,"
        f" max({col}) AS max, quantile_cont({col}, 0.25) AS p25, quantile_cont({col}, 0.5) AS p50,"
        f" quantile_cont({col}, 0.75) AS p75 FROM {src}{group}"
    )


DESCRIBED = ["mean", "std", "min", "max", "p25", "p50", "p75"]


@query("latency_describe", with_("lats") + _describe_sql("total_latency", "lats"), DESCRIBED)
def latency_describe(spark, folder):
    return lat.describe(v.latencies(spark, folder), "total_latency")


@query(
    "latency_box",
    with_(
        "ev",
        q="SELECT event_type, quantile_cont(value, 0.25) AS q1, median(value) AS median,"
        " quantile_cont(value, 0.75) AS q3 FROM ev GROUP BY event_type",
        r="SELECT ev.event_type, value, q1, median, q3, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"
        " AS ok FROM ev JOIN q ON ev.event_type = q.event_type",
    )
    + "SELECT event_type, max(q1) AS q1, max(median) AS median, max(q3) AS q3, min(value) FILTER (ok) AS whisker_lo,"
    " max(value) FILTER (ok) AS whisker_hi, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS outliers"
    " FROM r GROUP BY event_type",
    ["q1", "median", "q3", "whisker_lo", "whisker_hi"],
)
def latency_box(spark, folder):
    return lat.box_stats(v.events(spark, folder), "value", ["event_type"])


@query(
    "latency_kde",
    with_(
        "ev",
        a="SELECT event_type, count(value) AS n, min(value) AS lo, max(value) AS hi,"
        " stddev_samp(value) * pow(count(value), -0.2) AS h FROM ev GROUP BY event_type",
        b="SELECT event_type, n, h, greatest(lo - 3 * h, 0) AS lo, hi + 3 * h AS hi FROM a",
        p="SELECT event_type, i AS point, n, h, lo + i * ((hi - lo) / 199) AS gx FROM b, range(0, 200) t(i)",
    )
    + "SELECT p.event_type, p.point, max(gx) AS x,"
    " sum(exp(-0.5 * pow((gx - value) / h, 2))) / max(n * h * sqrt(2 * pi())) AS density"
    " FROM p JOIN ev ON p.event_type = ev.event_type WHERE value IS NOT NULL GROUP BY 1, 2",
    ["x", "density"],
)
def latency_kde(spark, folder):
    return lat.density(v.events(spark, folder), "value", ["event_type"])


@query(
    "latency_histogram",
    with_(
        "ev",
        a="SELECT event_type, min(value) AS lo, max(value) AS hi FROM ev GROUP BY event_type",
    )
    + "SELECT event_type, bin, max(lo) + (bin - 1) * ((max(hi) - max(lo)) / 50) AS bin_start, count(*) AS rows"
    " FROM (SELECT ev.event_type, lo, hi,"
    " least(CAST(floor(50 * (value - lo) / (hi - lo)) AS BIGINT) + 1, 50) AS bin"
    " FROM ev JOIN a ON ev.event_type = a.event_type) GROUP BY event_type, bin",
    ["bin_start"],
)
def latency_histogram(spark, folder):
    return lat.histogram(v.events(spark, folder), "value", 50, ["event_type"])


@query(
    "latency_axis_bound",
    with_("lng", q="SELECT stage, environment, quantile_cont(latency, 0.99) AS q FROM lng GROUP BY 1, 2")
    + "SELECT stage, max(q) * 1.1 AS bound FROM q GROUP BY stage",
    ["bound"],
)
def latency_axis_bound(spark, folder):
    return lat.axis_bound(long(spark, folder), "latency")


@query(
    "downsample_min_mean_max",
    with_(
        "ev",
        b="SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) AS bucket, min(value) AS min, avg(value) AS mean,"
        " max(value) AS max FROM ev GROUP BY 1, 2",
    )
    + " UNION ALL ".join(
        f"SELECT event_type, bucket, '{s}' AS stat, {s} AS value FROM b" for s in ("min", "mean", "max")
    ),
    ["value"],
)
def downsample_min_mean_max(spark, folder):
    return lat.downsample(v.events(spark, folder), "ts", "value", 1800, ["event_type"])


@query(
    "latency_sql_stats_approx",
    with_("lats")
    + "SELECT "
    + ", ".join(
        f"avg({c}) AS avg_{c}, stddev_samp({c}) AS stddev_{c}, min({c}) AS min_{c}, max({c}) AS max_{c},"
        f" quantile_disc({c}, 0.5) AS median_{c}"
        for c in STAGE_COLS[:2]
    )
    + " FROM lats",
    [f"{s}_{c}" for c in STAGE_COLS[:2] for s in ("avg", "stddev", "min", "max", "median")],
)
def latency_sql_stats_approx(spark, folder):
    return lat.approx_stats(v.latencies(spark, folder), STAGE_COLS[:2])


@query(
    "latency_deltas_melted",
    with_("lats")
    + "SELECT 'broker' AS delta, epoch_us(broker_ts) // 1000000 - epoch_us(source_ts) // 1000000 AS seconds FROM lats"
    " UNION ALL SELECT 'landing', epoch_us(landing_ts) // 1000000 - epoch_us(broker_ts) // 1000000 FROM lats",
)
def latency_deltas_melted(spark, folder):
    pairs = {"broker": ("broker_ts", "source_ts"), "landing": ("landing_ts", "broker_ts")}
    return lat.melt_deltas(v.pings(spark, folder), "deltas", pairs)


@query(
    "latency_by_action",
    with_("lats")
    + "SELECT part, time_bucket(INTERVAL 1 DAY, broker_ts) AS bucket, count(total_latency) AS messages,"
    " min(total_latency) AS min, avg(total_latency) AS mean, max(total_latency) AS max FROM lats GROUP BY 1, 2",
    ["min", "mean", "max"],
)
def latency_by_action(spark, folder):
    return lat.latency_by_action(v.latencies(spark, folder), "part", "broker_ts", "total_latency", 86400)


@query(
    "quantile_trim",
    with_("ev", q="SELECT quantile_cont(value, 0.015) AS lo, quantile_cont(value, 0.995) AS hi FROM ev")
    + "SELECT event_id, value FROM ev, q WHERE value > lo AND value <= hi",
    ["value"],
)
def quantile_trim(spark, folder):
    df = v.events(spark, folder).select("event_id", "value")
    return flt.trim_quantiles(df, {"value": (0.015, 0.995)}, lo_strict=True)


@query(
    "quantile_trim_grouped",
    with_("ev", q="SELECT event_type, quantile_cont(value, 0.95) AS hi FROM ev GROUP BY 1")
    + "SELECT event_id, ev.event_type, value FROM ev JOIN q ON ev.event_type = q.event_type WHERE value < hi",
    ["value"],
)
def quantile_trim_grouped(spark, folder):
    df = v.events(spark, folder).select("event_id", "event_type", "value")
    return flt.trim_quantiles(df, {"value": (None, 0.95)}, hi_strict=True, by=["event_type"], few_groups=True)


@query(
    "quantile_trim_multi",
    with_(
        "ev",
        q="SELECT quantile_cont(value, 0.0001) AS a, quantile_cont(value, 0.9999) AS b,"
        " quantile_cont(k, 0.01) AS c, quantile_cont(k, 0.99) AS d FROM ev",
    )
    + "SELECT event_id, value, k FROM ev, q WHERE value BETWEEN a AND b AND k BETWEEN c AND d",
    ["value"],
)
def quantile_trim_multi(spark, folder):
    df = v.events(spark, folder).select("event_id", "value", "k")
    return flt.trim_quantiles(df, {"value": (0.0001, 0.9999), "k": (0.01, 0.99)})


@query(
    "quantile_trim_report",
    with_("ev", q="SELECT quantile_cont(value, 0.95) AS hi FROM ev")
    + "SELECT count(*) AS total, count(*) FILTER (value <= hi) AS kept, count(*) FILTER (value > hi) AS removed"
    " FROM ev, q",
)
def quantile_trim_report(spark, folder):
    return flt.trim_report(v.events(spark, folder), "value", None, 0.95)


T0, T1 = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 12, 6)


@query(
    "time_range",
    with_("ev") + f"SELECT event_id, ts FROM ev WHERE ts BETWEEN TIMESTAMP '{T0}' AND TIMESTAMP '{T1}'",
)
def time_range(spark, folder):
    return flt.time_range(v.table(spark, folder, "events"), "ts", T0, T1).select("event_id", "ts")


@query(
    "time_range_open",
    with_("ev") + f"SELECT event_id FROM ev WHERE ts > TIMESTAMP '{T0}' AND ts < TIMESTAMP '{T1}'",
)
def time_range_open(spark, folder):
    return flt.time_range(v.table(spark, folder, "events"), "ts", T0, T1, inclusive=False).select("event_id")


@query(
    "time_around",
    with_("ev") + f"SELECT event_id FROM ev WHERE ts BETWEEN TIMESTAMP '{T0}' - INTERVAL 20 MINUTE"
    f" AND TIMESTAMP '{T0}' + INTERVAL 20 MINUTE",
)
def time_around(spark, folder):
    return flt.around(v.events(spark, folder), "ts", T0).select("event_id")


@query(
    "common_end_range",
    with_("lats", e="SELECT environment, max(broker_ts) AS t FROM lats GROUP BY 1")
    + "SELECT order_id, part, environment, broker_ts FROM lats WHERE broker_ts <= (SELECT min(t) FROM e)",
)
def common_end_range(spark, folder):
    df = v.pings(spark, folder).select("order_id", "part", "environment", "broker_ts")
    edge, cloud = df.where("environment = 'Edge'"), df.where("environment = 'Cloud'")
    a, b = flt.common_end(edge, cloud, "broker_ts")
    return a.unionByName(b)


@query(
    "label_filters",
    with_("csamples")
    + "SELECT event_id, pod, container, node FROM csamples WHERE container IS NOT NULL AND node <> 'w1'"
    " AND environment = 'Edge' AND container IN ('broker', 'main')"
    " AND (pod LIKE 'msg-bus%' OR pod LIKE 'blob%') AND (lower(pod) LIKE '%bus%' OR pod LIKE '%fs%')",
)
def label_filters(spark, folder):
    df = flt.labelled(v.container_samples(spark, folder), "container")
    df = flt.without_value(df, "node", "w1")
    df = flt.where_labels(df, environment="Edge", container=["broker", "main"])
    df = flt.where_prefix(df, "pod", ["msg-bus", "blob"])
    return flt.where_contains(df, "pod", ["BUS", "fs"]).select("event_id", "pod", "container", "node")


@query(
    "same_time",
    with_("pings") + "SELECT order_id, part FROM pings WHERE source_ts = broker_ts",
)
def same_time(spark, folder):
    return flt.same_time(v.pings(spark, folder), "source_ts", "broker_ts").select("order_id", "part")


@query(
    "negative_latency",
    with_("lats")
    + "SELECT environment, count(*) FILTER (source_broker_latency < 0) AS negative, count(*) AS total"
    " FROM lats GROUP BY environment",
)
def negative_latency(spark, folder):
    return flt.count_negative(v.latencies(spark, folder), "source_broker_latency", ["environment"])


@query(
    "slice_rows",
    with_("ev") + "SELECT event_id, ts, value FROM ev ORDER BY ts, event_id LIMIT 6980 OFFSET 20",
    ["value"],
)
def slice_rows(spark, folder):
    df = v.events(spark, folder).select("event_id", "ts", "value")
    return flt.slice_rows(df, ["ts", "event_id"], 20, 7000)


@query(
    "timestamp_normalize",
    with_("ev") + "SELECT event_id, ts AS iso_ts, date_trunc('milliseconds', ts) AS ms_ts,"
    " date_trunc('second', ts) AS s_ts, ts - INTERVAL 3 HOUR AS shifted FROM ev",
)
def timestamp_normalize(spark, folder):
    df = v.events(spark, folder).withColumns(
        {
            "text": F.when(
                F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
            ).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")),
            "ms": F.unix_millis("ts"),
            "s": F.unix_seconds("ts"),
        }
    )
    return df.select(
        "event_id",
        tm.normalize_ts("text").alias("iso_ts"),
        tm.normalize_ts(F.col("ms").cast("string"), "any").alias("ms_ts"),
        tm.normalize_ts("s", "epoch_s").alias("s_ts"),
        tm.normalize_ts("text", shift_hours=-3).alias("shifted"),
    )


@query(
    "zone_convert",
    with_("ev") + "SELECT event_id, timezone('America/Sao_Paulo', timezone('UTC', ts)) AS local_ts,"
    " strftime(timezone('America/Sao_Paulo', timezone('UTC', ts)), '%Hh%Mm%Ss') AS clock FROM ev",
)
def zone_convert(spark, folder):
    return v.events(spark, folder).select(
        "event_id", tm.to_zone("ts").alias("local_ts"), tm.format_clock("ts").alias("clock")
    )


@query(
    "relative_time",
    with_("ev", m="SELECT event_type, min(ts) AS t FROM ev GROUP BY 1")
    + "SELECT event_id, (epoch_us(ts) - epoch_us(t)) / 1e6 AS relative_s,"
    " CAST(floor((epoch_us(ts) - epoch_us(t)) / 1e6) AS BIGINT) % 86400 AS whole_s"
    " FROM ev JOIN m ON ev.event_type = m.event_type",
    ["relative_s"],
)
def relative_time(spark, folder):
    df = tm.relative_seconds(v.events(spark, folder), "ts", ["event_type"], few_groups=True)
    df = tm.relative_seconds(df, "ts", ["event_type"], whole=True, few_groups=True, name="whole_s")
    return df.select("event_id", "relative_s", "whole_s")


@query(
    "seconds_delta",
    with_("pings") + "SELECT order_id, part, epoch_us(broker_ts) // 1000000 - epoch_us(source_ts) // 1000000"
    " AS delta_s FROM pings",
)
def seconds_delta(spark, folder):
    delta = tm.seconds_between("broker_ts", "source_ts", truncate=True)
    return v.pings(spark, folder).select("order_id", "part", delta.alias("delta_s"))


@query(
    "time_extent",
    with_("lats") + "SELECT environment, min(broker_ts) AS first_ts, max(broker_ts) AS last_ts FROM lats GROUP BY 1",
)
def time_extent(spark, folder):
    return tm.extent(v.pings(spark, folder), "broker_ts", ["environment"])


@query(
    "duration_text",
    with_("ev") + "SELECT event_id, CASE WHEN s >= 3600 THEN printf('%dh%02dm%04.1fs', CAST(floor(s / 3600) AS BIGINT),"
    " CAST(floor((s % 3600) / 60) AS BIGINT), s % 60) WHEN s >= 60 THEN printf('%dm%04.1fs',"
    " CAST(floor(s / 60) AS BIGINT), s % 60) ELSE printf('%.1fs', s) END AS text"
    " FROM (SELECT event_id, CAST(floor(value) AS DOUBLE) * 37 AS s FROM ev)",
)
def duration_text(spark, folder):
    text = tm.format_duration(F.floor("value").cast("double") * 37)
    return v.events(spark, folder).select("event_id", text.alias("text"))
