"""Event log and network queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import eventlog as evl
from tidewatch.operators import network as net
from tidewatch.plans import views as v
from tidewatch.plans.latency_queries import DESCRIBED
from tidewatch.plans.registry import query
from tidewatch.plans.views import with_


@query("eventlog_jobs", with_("jobs") + "SELECT * FROM jobs", ["DurationSec"])
def eventlog_jobs(spark, folder):
    return evl.jobs(v.log_lines(spark, folder))


@query(
    "eventlog_stages",
    with_("stages", "owners")
    + "SELECT stages.*, CAST(0 AS BIGINT) AS StageAttemptID, owners.JobID FROM stages"
    " LEFT JOIN owners ON stages.StageID = owners.StageID",
    ["DurationSec"],
)
def eventlog_stages(spark, folder):
    return evl.stages(v.log_lines(spark, folder))


@query(
    "eventlog_tasks",
    "SELECT 'app-1' AS app, l_orderkey * 10 + l_linenumber AS TaskID, l_orderkey * 2 AS StageID,"
    " CAST(0 AS BIGINT) AS StageAttemptID, CAST(l_suppkey % 4 AS VARCHAR) AS ExecutorID, l_suppkey * 3 AS ShuffleReadBytes,"
    " l_suppkey * 5 AS ShuffleWriteBytes, CAST(l_linenumber * 1000 AS BIGINT) AS DiskBytesSpilled,"
    " CASE WHEN l_returnflag <> 'R' THEN epoch_ms(l_shipdate) + CAST(floor(l_extendedprice) AS BIGINT) END AS FinishTime,"
    " 'host-' || (l_suppkey % 10) AS Host, epoch_ms(l_shipdate) AS LaunchTime,"
    " CASE WHEN l_returnflag <> 'R' THEN CAST(floor(l_extendedprice) AS BIGINT) END AS Duration,"
    " l_linestatus <> 'F' AS Successful, l_partkey AS BytesRead, CAST(floor(l_quantity) AS BIGINT) AS MemoryBytesSpilled,"
    " CASE WHEN l_returnflag <> 'R' THEN floor(l_extendedprice) / 1000 END AS DurationSec FROM lineitem",
    ["DurationSec"],
)
def eventlog_tasks(spark, folder):
    return evl.tasks(v.log_lines(spark, folder))


@query(
    "eventlog_bad_lines",
    "SELECT 'app-1' AS app, '{broken ' || o_orderkey AS line FROM orders WHERE o_orderkey % 100 = 0",
)
def eventlog_bad_lines(spark, folder):
    return evl.bad_lines(v.log_lines(spark, folder))


@query(
    "stage_job_lookup",
    with_("owners") + "SELECT 'app-1' AS app, StageID, JobID FROM owners",
)
def stage_job_lookup(spark, folder):
    return evl.stage_to_job(v.log_lines(spark, folder))


NUMBERS = ["ID", "Attempt", "JobID", "SubmissionDay", "CompletionDay", "NumTasks", *evl.STAGE_ACCUMULABLES, "DurationSec"]
HISTORY = {
    "hs": "SELECT *, SubmissionTime / 86400000.0::DOUBLE AS SubmissionDay, CompletionTime / 86400000.0::DOUBLE AS CompletionDay FROM (SELECT 'job' AS Kind, JobID AS ID, NULL::BIGINT AS Attempt, JobID, SubmissionTime, CompletionTime, NULL::BIGINT AS NumTasks, "
    + ", ".join(f"NULL::BIGINT AS {c}" for c in evl.STAGE_ACCUMULABLES)
    + ", DurationSec, NULL AS Name FROM jobs UNION ALL SELECT 'stage', stages.StageID, 0, owners.JobID, SubmissionTime, CompletionTime, NumTasks, "
    + ", ".join(evl.STAGE_ACCUMULABLES)
    + ", DurationSec, StageName FROM stages LEFT JOIN owners ON stages.StageID = owners.StageID)",
}


@query(
    "eventlog_summary",
    with_("jobs", "stages", "owners", **HISTORY)
    + " UNION ALL ".join(
        f"SELECT Kind, '{c}' AS \"column\", count({c}) AS count, avg({c}::DOUBLE) AS mean, stddev_samp({c}::DOUBLE) AS std,"
        f" min({c}::DOUBLE) AS min, max({c}::DOUBLE) AS max, quantile_cont({c}::DOUBLE, 0.25) AS p25,"
        f" quantile_cont({c}::DOUBLE, 0.5) AS p50, quantile_cont({c}::DOUBLE, 0.75) AS p75 FROM hs"
        f" WHERE {c} IS NOT NULL GROUP BY Kind"
        for c in NUMBERS
    ),
    DESCRIBED,
)
def eventlog_summary(spark, folder):
    days = {f"{c}Day": F.col(f"{c}Time") / 86_400_000.0 for c in ("Submission", "Completion")}
    return evl.summarize_history(evl.history(v.log_lines(spark, folder)).withColumns(days), NUMBERS)


@query(
    "eventlog_history",
    with_("jobs", "stages", "owners", **HISTORY) + "SELECT Kind, ID, Attempt, JobID, Name, SubmissionTime, CompletionTime, NumTasks, DurationSec FROM hs",
    ["DurationSec"],
)
def eventlog_history(spark, folder):
    return evl.history(v.log_lines(spark, folder)).select(
        "Kind", "ID", "Attempt", "JobID", "Name", "SubmissionTime", "CompletionTime", "NumTasks", "DurationSec"
    )


@query(
    "top_k_shuffle_read",
    with_("jobs", "stages", "owners", **HISTORY)
    + "SELECT ID, Name, ShuffleReadBytes FROM hs WHERE Kind = 'stage' ORDER BY ShuffleReadBytes DESC, ID LIMIT 5",
)
def top_k_shuffle_read(spark, folder):
    stages = evl.history(v.log_lines(spark, folder)).where("Kind = 'stage'")
    return evl.slowest(stages, "ShuffleReadBytes", tie=["ID"]).select("ID", "Name", "ShuffleReadBytes")


@query(
    "stage_duration_series",
    with_("jobs", "stages", "owners", **HISTORY)
    + "SELECT ID, JobID, CASE JobID % 3 WHEN 0 THEN 'Planning' WHEN 1 THEN 'Kafka Fetch' ELSE 'Transformations' END AS JobType,"
    " timezone('America/Sao_Paulo', timezone('UTC', epoch_ms(SubmissionTime))) AS StartedAt,"
    " DurationSec, (SELECT avg(DurationSec) FROM stages) AS MeanSec FROM hs WHERE Kind = 'stage'",
    ["DurationSec", "MeanSec"],
)
def stage_duration_series(spark, folder):
    history = evl.history(v.log_lines(spark, folder)).select("Kind", "ID", "JobID", "SubmissionTime", "DurationSec")
    series = evl.stage_series(history)
    return series.select("ID", "JobID", "JobType", "StartedAt", "DurationSec", "MeanSec")


@query(
    "top_k_slowest",
    with_("stages") + "SELECT StageID, StageName, DurationSec FROM stages ORDER BY DurationSec DESC, StageID LIMIT 5",
    ["DurationSec"],
)
def top_k_slowest(spark, folder):
    return evl.slowest(evl.stages(v.log_lines(spark, folder)), tie=["StageID"]).select("StageID", "StageName", "DurationSec")


@query(
    "job_type",
    "SELECT o_orderkey AS JobID, CASE o_orderkey % 3 WHEN 0 THEN 'Planning' WHEN 1 THEN 'Kafka Fetch'"
    " ELSE 'Transformations' END AS JobType FROM orders",
)
def job_type(spark, folder):
    return evl.jobs(v.log_lines(spark, folder)).select("JobID", evl.job_type("JobID").alias("JobType"))


@query(
    "duration_series",
    with_("jobs")
    + "SELECT JobID, timezone('America/Sao_Paulo', timezone('UTC', epoch_ms(SubmissionTime))) AS StartedAt,"
    " DurationSec, (SELECT avg(DurationSec) FROM jobs) AS MeanSec FROM jobs",
    ["DurationSec", "MeanSec"],
)
def duration_series(spark, folder):
    return evl.duration_series(evl.jobs(v.log_lines(spark, folder))).select("JobID", "StartedAt", "DurationSec", "MeanSec")


def packets(spark, folder):
    return net.to_broker(v.packets(spark, folder), v.BROKER_IP, v.BROKER_PORT)


@query(
    "broker_packets",
    with_("packets") + "SELECT packet_id, to_broker, client_ip, client_port FROM packets",
)
def broker_packets(spark, folder):
    return packets(spark, folder).select("packet_id", "to_broker", "client_ip", "client_port")


@query(
    "tcp_health",
    with_("packets") + "SELECT to_broker, count(*) AS packets, count(*) FILTER (tcp_flags & 4 <> 0) AS resets,"
    " count(*) FILTER (window_size = 0) AS zero_windows FROM packets GROUP BY 1",
)
def tcp_health(spark, folder):
    return net.tcp_health(packets(spark, folder), ["to_broker"])


@query(
    "retransmissions",
    with_("packets")
    + "SELECT src_ip, dst_ip, sport, dport, count(*) AS packets, count(*) - count(DISTINCT seq) AS retransmissions"
    " FROM packets WHERE payload_len > 0 GROUP BY 1, 2, 3, 4",
)
def retransmissions(spark, folder):
    return net.retransmissions(packets(spark, folder))


def _matched(keys: str) -> dict[str, str]:
    return {
        "m": "SELECT *, lag(to_broker) OVER w AS asked, lag(ts) OVER w AS asked_ts FROM packets"
        f" WHERE payload_len > 12 WINDOW w AS (PARTITION BY {keys} ORDER BY ts, packet_id)",
        "l": "SELECT packet_id, cid, ts, (epoch_us(ts) - epoch_us(asked_ts)) / 1e3 AS broker_latency_ms FROM m"
        " WHERE NOT to_broker AND asked",
    }


@query("request_response_match", with_("packets", **_matched("cid")) + "SELECT * FROM l", ["broker_latency_ms"])
def request_response_match(spark, folder):
    return net.match_requests(packets(spark, folder))


@query(
    "request_response_match_flow",
    with_("packets", **_matched("client_ip, client_port, cid % 2"))
    + "SELECT packet_id, ts, broker_latency_ms FROM l",
    ["broker_latency_ms"],
)
def request_response_match_flow(spark, folder):
    df = packets(spark, folder).withColumn("cid", F.col("cid") % 2)
    return net.match_requests(df, ["client_ip", "client_port", "cid"]).drop("cid")


JITTER = {
    "g": "SELECT src_ip, ts, packet_id, (epoch_us(ts) - epoch_us(lag(ts) OVER"
    " (PARTITION BY src_ip ORDER BY ts, packet_id))) / 1e3 AS gap FROM packets WHERE NOT to_broker",
    "j": "SELECT src_ip, gap, abs(gap - lag(gap) OVER (PARTITION BY src_ip ORDER BY ts, packet_id)) AS change"
    " FROM g WHERE gap < 600000",
}


@query(
    "jitter",
    with_("packets", **JITTER)
    + "SELECT src_ip, count(*) AS gaps, avg(gap) AS mean_gap_ms, coalesce(avg(change), 0) AS jitter_ms FROM j GROUP BY 1",
    ["mean_gap_ms", "jitter_ms"],
)
def jitter(spark, folder):
    return net.jitter(packets(spark, folder), max_gap_ms=600_000)


RTT = {
    "h": "SELECT *, lag(tcp_flags & 18) OVER w AS before, lag(ts) OVER w AS opened FROM packets"
    " WHERE tcp_flags & 18 IN (2, 18) WINDOW w AS (PARTITION BY client_ip, client_port ORDER BY ts, packet_id)",
    "rt": "SELECT packet_id, client_ip, client_port, ts, (epoch_us(ts) - epoch_us(opened)) / 1e3 AS rtt_ms FROM h"
    " WHERE tcp_flags & 18 = 18 AND before = 2",
}


@query("rtt", with_("packets", **RTT) + "SELECT * FROM rt", ["rtt_ms"])
def rtt(spark, folder):
    return net.rtt(packets(spark, folder))


@query(
    "packet_table",
    with_(
        "packets",
        **_matched("cid"),
        **RTT,
        x="SELECT packet_id, row_number() OVER (PARTITION BY src_ip, dst_ip, sport, dport, seq ORDER BY ts, packet_id)"
        " AS rn FROM packets WHERE payload_len > 0",
    )
    + "SELECT p.packet_id, p.ts, src_ip, dst_ip, tcp_flags, window_size, payload_len, rtt_ms, broker_latency_ms,"
    " CASE WHEN rn > 1 THEN 1 ELSE 0 END AS is_retransmission, 0 AS actual_msg_count FROM packets p"
    " LEFT JOIN l ON l.packet_id = p.packet_id LEFT JOIN rt ON rt.packet_id = p.packet_id"
    " LEFT JOIN x ON x.packet_id = p.packet_id",
    ["rtt_ms", "broker_latency_ms"],
)
def packet_table(spark, folder):
    return net.packet_table(packets(spark, folder))


@query(
    "network_report",
    with_("packets", **_matched("cid"), g=JITTER["g"], j=JITTER["j"].replace("600000", "1000"))
    + "SELECT count(*) AS packets, count(*) FILTER (tcp_flags & 4 <> 0) AS resets,"
    " count(*) FILTER (window_size = 0) AS zero_windows,"
    " (SELECT CAST(sum(c) AS BIGINT) FROM (SELECT count(*) - 1 AS c FROM packets WHERE payload_len > 0"
    " GROUP BY src_ip, dst_ip, sport, dport, seq)) AS retransmissions,"
    " (SELECT coalesce(avg(change), 0) FROM j) AS jitter_ms, (SELECT avg(broker_latency_ms) FROM l) AS latency_avg_ms,"
    " (SELECT quantile_cont(broker_latency_ms, 0.95) FROM l) AS latency_p95_ms FROM packets",
    ["jitter_ms", "latency_avg_ms", "latency_p95_ms"],
)
def network_report(spark, folder):
    return net.network_report(packets(spark, folder))
