"""Pod life cycle queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidewatch.functions import naming as nm
from tidewatch.operators import pods
from tidewatch.plans import views as v
from tidewatch.plans.registry import query
from tidewatch.plans.views import with_

SPANS = {
    "Edge": (dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 20)),
    "Cloud": (dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 28)),
}
SELECTED = [p for prefixes in v.SERVICES.values() for p in prefixes]
BUS_AND_STORE = [*v.SERVICES["Store"], *v.SERVICES["Queue"]]
GAP = 6 * 3600
DRIVER = "regexp_matches(pod, '-driver$')"
WORKER = "regexp_matches(pod, '-exec-[0-9]+$')"


def prefix_case(names: dict[str, str], col: str) -> str:
    return "CASE " + " ".join(f"WHEN starts_with({col}, '{p}') THEN '{n}'" for p, n in names.items())


@query(
    "phase_segments",
    with_(
        "act",
        f="SELECT *, CASE WHEN phase IS DISTINCT FROM lag(phase) OVER w THEN 1 ELSE 0 END AS new FROM act"
        " WINDOW w AS (PARTITION BY pod ORDER BY timestamp, event_id)",
        s="SELECT *, CAST(sum(new) OVER (PARTITION BY pod ORDER BY timestamp, event_id) AS BIGINT) AS segment FROM f",
    )
    + "SELECT pod, segment, max(phase) AS phase, min(timestamp) AS start_ts, max(timestamp) AS end_ts,"
    " count(*) AS samples FROM s GROUP BY pod, segment",
)
def phase_segments(spark, folder):
    return pods.phase_segments(pods.active(v.phases(spark, folder)), tie=["event_id"])


def _blocks(src: str, gap: int) -> dict[str, str]:
    return {
        "g": "SELECT *, CASE WHEN (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w)) / 1e6 <= "
        f"{gap} THEN 0 ELSE 1 END AS new FROM {src} WINDOW w AS (PARTITION BY pod ORDER BY timestamp, event_id)",
        "b": "SELECT *, sum(new) OVER (PARTITION BY pod ORDER BY timestamp, event_id) AS block FROM g",
        "i": "SELECT pod, min(timestamp) AS start_ts, max(timestamp) AS end_ts, min(namespace) AS namespace,"
        " (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6 AS s FROM b GROUP BY pod, block",
    }


RUN = {"run": "SELECT * FROM act WHERE phase = 'Running'"}


@query(
    "running_intervals",
    with_("act", **RUN, **_blocks("run", GAP))
    + "SELECT pod, start_ts, end_ts, namespace, CASE WHEN s < 5 THEN 30 ELSE s END AS duration_s FROM i",
    ["duration_s"],
)
def running_intervals(spark, folder):
    running = pods.active(v.phases(spark, folder)).where("phase = 'Running'")
    return pods.running_intervals(running, gap=GAP, tie=["event_id"])


@query(
    "scrape_gaps",
    with_(
        "phases",
        t="SELECT DISTINCT environment, timestamp FROM phases",
        d="SELECT environment, lag(timestamp) OVER w AS gap_start, timestamp AS gap_end FROM t"
        " WINDOW w AS (PARTITION BY environment ORDER BY timestamp)",
        g="SELECT *, (epoch_us(gap_end) - epoch_us(gap_start)) / 1e6 AS duration_s FROM d",
    )
    + "SELECT * FROM g WHERE duration_s > 45",
    ["duration_s"],
)
def scrape_gaps(spark, folder):
    return pods.scrape_gaps(v.phases(spark, folder))


RESTARTS = {
    "o": "SELECT *, phase <> 'Running' AS late FROM act",
    "r": "SELECT *, lag(phase) OVER w AS before, min(CASE WHEN phase = 'Running' THEN timestamp END) OVER"
    " (PARTITION BY pod ORDER BY timestamp, late, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    " AS running_time FROM o WINDOW w AS (PARTITION BY pod ORDER BY timestamp, late, event_id)",
}
RESTARTED = (
    "SELECT pod, timestamp AS restart_time, running_time FROM r WHERE phase = 'Pending' AND before <> 'Pending'"
)


@query("pod_restarts", with_("act", **RESTARTS) + RESTARTED)
def pod_restarts(spark, folder):
    return pods.restarts(v.phases(spark, folder), tie=["event_id"])


@query(
    "service_restarts",
    with_("act", **RESTARTS)
    + RESTARTED
    + " AND ("
    + " OR ".join(f"starts_with(pod, '{p}')" for p in BUS_AND_STORE)
    + ")",
)
def service_restarts(spark, folder):
    return pods.service_restarts(v.phases(spark, folder), BUS_AND_STORE, tie=["event_id"])


TRUE_STARTS = {
    "f": "SELECT *, count(*) FILTER (phase <> 'Running') OVER later AS other,"
    " count(*) FILTER (phase IN ('Failed', 'Succeeded', 'Pending', 'Unknown')) OVER later AS known"
    " FROM act WHERE regexp_matches(lower(pod), 'driver|exec') WINDOW later AS (PARTITION BY pod"
    " ORDER BY timestamp, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)",
    "starts": "SELECT pod, min(timestamp) AS start_ts FROM f WHERE phase = 'Running'"
    " AND (coalesce(other, 0) = 0 OR known > 0) GROUP BY pod",
}


@query("true_starts", with_("act", **TRUE_STARTS) + "SELECT * FROM starts")
def true_starts(spark, folder):
    return pods.true_starts(v.phases(spark, folder))


@query(
    "warmup",
    with_(
        "act",
        f="SELECT environment, pod, min(timestamp) AS t FROM act WHERE phase = 'Running' GROUP BY 1, 2",
        w=f"SELECT environment, min(t) FILTER ({DRIVER}) AS warm_start, max(t) FILTER ({WORKER}) AS warm_end"
        " FROM f GROUP BY 1",
    )
    + "SELECT *, CASE WHEN warm_end > warm_start THEN (epoch_us(warm_end) - epoch_us(warm_start)) / 1e6 END"
    " AS warmup_s FROM w",
    ["warmup_s"],
)
def warmup(spark, folder):
    return pods.warmup(v.phases(spark, folder))


@query(
    "worker_labels",
    with_(
        "phases",
        p=f"SELECT DISTINCT environment, pod, CASE WHEN {WORKER} THEN 'worker' WHEN {DRIVER} THEN 'driver'"
        " ELSE 'other' END AS role FROM phases",
        r="SELECT *, row_number() OVER (PARTITION BY environment, role ORDER BY"
        " CASE WHEN role = 'worker' THEN CAST(regexp_extract(pod, '([0-9]+)$', 1) AS BIGINT) END NULLS LAST, pod)"
        " AS rn FROM p",
    )
    + "SELECT environment, pod, role, CASE WHEN role = 'worker' THEN 'spark-worker-' || rn"
    " WHEN role = 'driver' AND rn = 1 THEN 'spark-driver' ELSE pod END AS label FROM r",
)
def worker_labels(spark, folder):
    return pods.role_labels(v.phases(spark, folder))


BARE = (
    "array_to_string(list_concat(string_split(pod, '-')[1:1], list_filter(string_split(pod, '-')[2:],"
    " lambda x: NOT regexp_full_match(x, '[a-z0-9]{5,}'))), '-')"
)


@query(
    "name_normalize",
    with_("phases", p=f"SELECT DISTINCT pod, {BARE} AS bare FROM phases")
    + "SELECT pod, CASE "
    + " ".join(
        f"WHEN starts_with(bare, '{p}') THEN replace(bare, '{p}', '{n}')" for p, n in v.SHORT_NAMES.items()
    )
    + " ELSE array_to_string(string_split(bare, '-')[1:3], '-') END AS short,"
    " CASE WHEN regexp_matches(pod, '-exec-[0-9]+$') THEN 'spark-executor-' || regexp_extract(pod, '([0-9]+)$', 1)"
    f" ELSE {prefix_case(v.COMPONENTS, 'pod')} ELSE pod END END AS component FROM p",
)
def name_normalize(spark, folder):
    return (
        v.phases(spark, folder)
        .select("pod")
        .distinct()
        .select("pod", nm.short_name("pod", v.SHORT_NAMES).alias("short"), nm.component_name("pod", v.COMPONENTS).alias("component"))
    )


@query(
    "service_groups",
    with_("phases")
    + "SELECT DISTINCT pod, CASE "
    + " ".join(
        f"WHEN {' OR '.join(f'''starts_with(pod, '{p}')''' for p in ps)} THEN '{g}'"
        for g, ps in v.SERVICES.items()
    )
    + " END AS service, CASE WHEN contains(pod, 'driver') THEN 'Driver' WHEN contains(pod, 'exec')"
    " THEN 'Exc-' || string_split(pod, '-exec-')[-1] ELSE pod END AS start_label FROM phases",
)
def service_groups(spark, folder):
    return (
        v.phases(spark, folder)
        .select("pod", nm.service_group("pod", v.SERVICES).alias("service"), nm.start_label("pod").alias("start_label"))
        .distinct()
    )


@query(
    "starts_on_node",
    with_("act", **TRUE_STARTS)
    + "SELECT pod, start_ts FROM starts WHERE pod IN (SELECT pod FROM phases WHERE node = 'w1')",
)
def starts_on_node(spark, folder):
    df = v.phases(spark, folder)
    return pods.starts_on_node(pods.true_starts(df), df, "w1")


IN_SPAN = " OR ".join(
    f"environment = '{e}' AND timestamp BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}'" for e, (a, b) in SPANS.items()
)
ORIGIN = "CASE environment " + " ".join(f"WHEN '{e}' THEN TIMESTAMP '{a}'" for e, (a, _) in SPANS.items()) + " END"
DISRUPTION = {
    "run": f"SELECT * FROM act WHERE phase = 'Running' AND ({IN_SPAN}) AND namespace IN ('intake', 'batch')",
    "g": "SELECT *, CASE WHEN (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w)) / 1e6 <= "
    f"{GAP} THEN 0 ELSE 1 END AS new FROM run WINDOW w AS (PARTITION BY environment, pod ORDER BY timestamp, event_id)",
    "b": "SELECT *, sum(new) OVER (PARTITION BY environment, pod ORDER BY timestamp, event_id) AS block FROM g",
    "i": "SELECT environment, pod, min(timestamp) AS start_ts, max(timestamp) AS end_ts, min(namespace) AS namespace,"
    " (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6 AS s FROM b GROUP BY environment, pod, block",
    "c": "SELECT *, CASE WHEN regexp_matches(pod, '-exec-[0-9]+$') THEN"
    " 'spark-executor-' || regexp_extract(pod, '([0-9]+)$', 1)"
    f" ELSE {prefix_case(v.COMPONENTS, 'pod')} ELSE pod END END AS component FROM i",
    "iv": "SELECT environment, pod, component, namespace, start_ts, end_ts, CASE WHEN s < 5 THEN 30 ELSE s END AS duration_s,"
    f" (epoch_us(start_ts) - epoch_us({ORIGIN})) / 1e6 AS start_offset_s FROM c WHERE "
    + " OR ".join(f"starts_with(component, '{p}')" for p in v.REPORTED),
}


def _disruption(df):
    return pods.disruption(
        df, SPANS, v.COMPONENTS, namespaces=v.NAMESPACES, reported=v.REPORTED, gap=GAP, tie=["event_id"]
    )


@query("disruption", with_("act", **DISRUPTION) + "SELECT * FROM iv", ["duration_s", "start_offset_s"])
def disruption(spark, folder):
    return _disruption(v.phases(spark, folder))


@query(
    "disruption_uptime",
    with_(
        "act",
        **DISRUPTION,
        t=f"SELECT DISTINCT environment, timestamp FROM phases WHERE {IN_SPAN}",
        p="SELECT environment, lag(timestamp) OVER (PARTITION BY environment ORDER BY timestamp) AS a, timestamp AS b FROM t",
        gaps="SELECT * FROM p WHERE (epoch_us(b) - epoch_us(a)) / 1e6 > 45",
        every="SELECT DISTINCT environment, component FROM iv",
        moves="SELECT environment, component, start_ts AS ts, 1 AS up, 0 AS gap FROM iv"
        " UNION ALL SELECT environment, component, end_ts, -1, 0 FROM iv"
        " UNION ALL SELECT e.environment, component, a, 0, 1 FROM every e JOIN gaps ON e.environment = gaps.environment"
        " UNION ALL SELECT e.environment, component, b, 0, -1 FROM every e JOIN gaps ON e.environment = gaps.environment",
        m="SELECT environment, component, ts, sum(up) AS up, sum(gap) AS gap FROM moves GROUP BY 1, 2, 3",
        s="SELECT environment, component, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6 AS s,"
        " sum(up) OVER w AS ups, sum(gap) OVER w AS gaps FROM m"
        " WINDOW w AS (PARTITION BY environment, component ORDER BY ts)",
        u="SELECT environment, component, coalesce(sum(s) FILTER (ups > 0 AND gaps = 0), 0) AS up_s,"
        " coalesce(sum(s) FILTER (gaps > 0), 0) AS unseen_s FROM s GROUP BY 1, 2",
    )
    + "SELECT *, CASE environment "
    + " ".join(f"WHEN '{e}' THEN {(b - a).total_seconds()}" for e, (a, b) in SPANS.items())
    + f" END - up_s - unseen_s AS down_s, {max((b - a).total_seconds() for a, b in SPANS.values())}::DOUBLE AS max_span_s FROM u",
    ["up_s", "unseen_s", "down_s"],
)
def disruption_uptime(spark, folder):
    df = v.phases(spark, folder)
    return pods.availability(_disruption(df), pods.disruption_gaps(df, SPANS), SPANS)


@query(
    "common_span",
    with_("phases", e="SELECT (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6 AS s FROM phases GROUP BY environment")
    + "SELECT max(s) AS max_span_s FROM e",
    ["max_span_s"],
)
def common_span(spark, folder):
    df = v.phases(spark, folder)
    return pods.common_span([df.where(F.col("environment") == e) for e in ("Edge", "Cloud")])


@query(
    "selected_pods",
    with_("phases")
    + "SELECT DISTINCT pod FROM phases WHERE "
    + " OR ".join(f"starts_with(pod, '{p}')" for p in SELECTED),
)
def selected_pods(spark, folder):
    df = v.phases(spark, folder)
    return df.where(nm.starts_with_any("pod", SELECTED)).select("pod").distinct()
