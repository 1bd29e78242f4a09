"""Telemetry-shaped views of the given tables, in Spark and as SQL common table expressions.

pings: lines of orders as messages. counters, containers, phases, packets and
loadtest: the event stream as metric samples, container metrics, pod phases,
packets and load-test samples. log lines: orders and lines as a Spark event log.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.latency import stage_latencies
from tidewatch.operators.ordered import Ordered

# Pods of the views, and the tables of names for them.
SHORT_NAMES = {"etl-run-exec": "worker", "etl-run": "etl", "msg-bus": "bus"}
COMPONENTS = {"etl-run": "etl-driver", "msg-bus": "broker", "blob-s3": "store"}
SERVICES = {"Queue": ["msg-bus"], "Store": ["blob-s3", "blob-fs"], "Batch": ["etl-run"]}
REPORTED = ["broker", "store", "etl-driver", "spark-executor"]
NAMESPACES = ["intake", "batch"]
TOPIC = "orders"
BROKER_IP, BROKER_PORT = "10.0.0.1", 9092
NODES = ["w0", "w1", "w2"]
#: Rows of a table that one task of a join takes.
PART_ROWS = 1_000_000
LIMITS = [("w0", 400.0, 16.0), ("w1", 400.0, 16.0), ("w2", 800.0, 40.0)]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    k = F.regexp_extract("props", r"[0-9]+", 0).cast("int")
    return table(spark, folder, "events").withColumns({"ts": F.col("ts").cast("timestamp"), "k": k})


def _in_parts(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables dealt by their key into parts of about `PART_ROWS` rows of the left one, so
    that the sort of a join holds as much per task whatever the size and the shuffle's setting.
    The right one is not broadcast: its footers tell little of the memory its keys take. Rows
    are counted from the footers; one part's worth is left to Spark."""
    rows = left.count()
    if rows <= PART_ROWS:
        return left, right
    parts = max(math.ceil(rows / PART_ROWS), left.sparkSession.sparkContext.defaultParallelism)
    return left.repartition(parts, left_key), right.repartition(parts, right_key).hint("merge")


def pings(spark: SparkSession, folder: str) -> DataFrame:
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    lines, orders = _in_parts(lines, orders, "l_orderkey", "o_orderkey")
    day = F.make_dt_interval(F.col("l_linenumber"))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("part"),
        F.col("l_suppkey").alias("robot"),
        F.col("l_partkey").alias("item"),
        F.when(F.col("l_linestatus") == "O", "Edge").otherwise("Cloud").alias("environment"),
        F.col("o_orderdate").cast("timestamp").alias("source_ts"),
        F.col("l_shipdate").cast("timestamp").alias("broker_ts"),
        (F.col("l_shipdate").cast("timestamp") + day).alias("landing_ts"),
    )


def latencies(spark: SparkSession, folder: str) -> DataFrame:
    return stage_latencies(pings(spark, folder), "source_ts", "broker_ts", "landing_ts")


def _cents():
    return F.round(F.col("raw") * 100).cast("long")


def daily_counter(df: DataFrame, by: str) -> DataFrame:
    """A counter in whole units that starts over every day."""
    df = df.withColumn("_day", F.to_date("timestamp"))
    counted = Ordered(df, [by, "_day"], ["timestamp", "event_id"]).running_sum(_cents(), "value").result()
    return counted.withColumn("value", F.col("value").cast("double")).drop("_day")


def samples(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).select(
        "event_id",
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("series"),
        F.concat(F.lit("w"), (F.col("user_id") % 3).cast("string")).alias("node"),
        F.col("value").alias("raw"),
    )


def counters(spark: SparkSession, folder: str) -> DataFrame:
    return daily_counter(samples(spark, folder), "series")


def container_samples(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    pod = (
        F.when(kind == "view", "msg-bus-0")
        .when(kind == "click", "msg-bus-1-fv5kx")
        .when(kind == "signup", "blob-s3-0")
        .when(kind == "purchase", "blob-fs-0")
        .otherwise("app-driver")
    )
    slot = (F.col("user_id") % 3).cast("string")
    env = F.when(F.col("user_id") % 2 == 0, "Edge").otherwise("Cloud")
    return events(spark, folder).select(
        "event_id",
        F.col("ts").alias("timestamp"),
        env.alias("environment"),
        pod.alias("pod"),
        F.concat_ws("/", env, pod, slot).alias("id"),
        F.concat(F.lit("w"), slot).alias("node"),
        F.when(F.col("k") % 10 != 0, F.when(slot == "0", "broker").otherwise("main")).alias("container"),
        F.when(F.col("k") % 2 == 0, TOPIC).otherwise("other").alias("topic"),
        F.col("value").alias("raw"),
    )


def container_counters(spark: SparkSession, folder: str) -> DataFrame:
    return daily_counter(container_samples(spark, folder), "id").drop("raw")


def container_memory(spark: SparkSession, folder: str) -> DataFrame:
    return container_samples(spark, folder).withColumn("value", F.col("raw") * 1e7).drop("raw")


def limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LIMITS, "node string, cpu_limit double, mem_limit double")


def phases(spark: SparkSession, folder: str) -> DataFrame:
    user, kind = F.col("user_id"), F.col("event_type")
    number = user.cast("string")
    pod = (
        F.when(user % 5 == 0, F.concat(F.lit("etl-run-exec-"), number))
        .when(user % 5 == 1, F.concat(F.lit("etl-run-"), number, F.lit("-driver")))
        .when(user % 5 == 2, F.concat(F.lit("msg-bus-"), number))
        .when(user % 5 == 3, F.concat(F.lit("blob-s3-"), number))
        .otherwise(F.concat(F.lit("web-ui-"), number, F.lit("-abcdef1234")))
    )
    phase = (
        F.when(kind.isin("view", "click"), "Running")
        .when(kind == "signup", "Pending")
        .when(kind == "error", "Failed")
        .when(F.col("k") % 3 == 0, "Evicted")
        .otherwise("Succeeded")
    )
    space = F.when(user % 3 == 0, "intake").when(user % 3 == 1, "batch").otherwise("system")
    return events(spark, folder).select(
        "event_id",
        F.col("ts").alias("timestamp"),
        pod.alias("pod"),
        space.alias("namespace"),
        phase.alias("phase"),
        F.when(F.col("k") % 7 == 0, 0.0).otherwise(1.0).alias("value"),
        F.when(user % 2 == 0, "Edge").otherwise("Cloud").alias("environment"),
        F.concat(F.lit("w"), (user % 3).cast("string")).alias("node"),
    )


def packets(spark: SparkSession, folder: str) -> DataFrame:
    user, k = F.col("user_id"), F.col("k")
    there = F.col("event_type").isin("view", "click", "signup")
    client = F.concat(
        F.lit("10.1."), F.floor(user / 256).cast("string"), F.lit("."), (user % 256).cast("string")
    )
    broker = F.when(F.col("event_id") % 11 == 0, "10.0.0.2").otherwise(BROKER_IP)
    port = (F.lit(40000) + user % 1000).cast("int")
    flags = (
        F.when(k % 20 == 0, 4)
        .when(k % 20 < 3, F.when(there, 2).otherwise(18))
        .when(k % 20 < 10, 16)
        .otherwise(24)
    )
    return events(spark, folder).select(
        F.col("event_id").alias("packet_id"),
        "ts",
        F.when(there, client).otherwise(broker).alias("src_ip"),
        F.when(there, broker).otherwise(client).alias("dst_ip"),
        F.when(there, port).otherwise(BROKER_PORT).alias("sport"),
        F.when(there, BROKER_PORT).otherwise(port).alias("dport"),
        flags.alias("tcp_flags"),
        F.when(k % 25 == 3, 0).otherwise(64240).alias("window_size"),
        k.alias("payload_len"),
        F.floor("value").cast("long").alias("seq"),
        (F.col("event_id") % 50).alias("cid"),
    )


def loadtest(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    metric = (
        F.when(kind == "view", "kafka_writer_wait_seconds")
        .when(kind == "click", "kafka_writer_write_seconds")
        .when(kind == "signup", "iteration_duration")
        .when(kind == "purchase", "iterations")
        .otherwise("kafka_writer_error_count")
    )
    return events(spark, folder).select(
        "event_id",
        "ts",
        F.unix_seconds("ts").alias("timestamp"),
        metric.alias("metric_name"),
        F.col("value").alias("metric_value"),
        F.when(F.col("user_id") % 2 == 0, "Edge").otherwise("Cloud").alias("environment"),
        F.col("user_id").alias("robot_id"),
    )


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Orders and their lines written as event log lines, with a few that are not JSON."""
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    key = F.col("o_orderkey")
    start = F.unix_millis(F.col("o_orderdate").cast("timestamp")) + key % 1000

    def stage(n):
        return F.struct((key * 2 + n).alias("Stage ID"))

    def acc(name, value):
        return F.struct(F.lit(name).alias("Name"), value.cast("string").alias("Value"))

    def text(df, *fields):
        return df.select(F.to_json(F.struct(*fields)).alias("value"))

    event = "Event"
    started = text(
        orders,
        F.lit("SparkListenerJobStart").alias(event),
        key.alias("Job ID"),
        start.alias("Submission Time"),
        F.array(stage(0), stage(1), stage(2)).alias("Stage Infos"),
    )
    result = F.when(F.col("o_orderstatus") == "F", "JobFailed").otherwise("JobSucceeded")
    ended = text(
        orders.where("o_orderstatus <> 'P'"),
        F.lit("SparkListenerJobEnd").alias(event),
        key.alias("Job ID"),
        (start + F.floor("o_totalprice")).alias("Completion Time"),
        F.struct(result.alias("Result")).alias("Job Result"),
    )
    done = text(
        orders,
        F.lit("SparkListenerStageCompleted").alias(event),
        F.struct(
            (key * 2).alias("Stage ID"),
            F.lit(0).alias("Stage Attempt ID"),
            F.col("o_orderpriority").alias("Stage Name"),
            start.alias("Submission Time"),
            (start + F.floor(F.col("o_totalprice") / 2)).alias("Completion Time"),
            (F.col("o_custkey") % 50).alias("Number of Tasks"),
            F.array_compact(
                F.array(
                    acc("internal.metrics.input.recordsRead", F.col("o_custkey")),
                    acc("internal.metrics.jvmGCTime", key % 97),
                    acc("internal.metrics.shuffle.read.remoteBytesRead", key * 37 % 100_003),
                    F.when(key % 2 == 0, acc("internal.metrics.shuffle.write.bytesWritten", key * 11)),
                    acc("internal.metrics.output.recordsWritten", F.col("o_custkey") * 2),
                    F.when(key % 3 == 0, acc("duration", key)),
                )
            ).alias("Accumulables"),
        ).alias("Stage Info"),
    )
    launch = F.unix_millis(F.col("l_shipdate").cast("timestamp"))
    ran = text(
        lines,
        F.lit("SparkListenerTaskEnd").alias(event),
        (F.col("l_orderkey") * 2).alias("Stage ID"),
        F.lit(0).alias("Stage Attempt ID"),
        F.struct(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("Task ID"),
            (F.col("l_suppkey") % 4).cast("string").alias("Executor ID"),
            F.concat(F.lit("host-"), (F.col("l_suppkey") % 10).cast("string")).alias("Host"),
            launch.alias("Launch Time"),
            F.when(F.col("l_returnflag") != "R", launch + F.floor("l_extendedprice")).alias("Finish Time"),
            (F.col("l_linestatus") == "F").alias("Failed"),
        ).alias("Task Info"),
        F.struct(
            F.col("l_quantity").cast("long").alias("Memory Bytes Spilled"),
            (F.col("l_linenumber") * 1000).cast("long").alias("Disk Bytes Spilled"),
            F.struct(F.col("l_partkey").alias("Bytes Read")).alias("Input Metrics"),
            F.struct((F.col("l_suppkey") * 3).alias("Remote Bytes Read")).alias("Shuffle Read Metrics"),
            F.struct((F.col("l_suppkey") * 5).alias("Shuffle Bytes Written")).alias("Shuffle Write Metrics"),
        ).alias("Task Metrics"),
    )
    broken = orders.where(key % 100 == 0).select(
        F.concat(F.lit("{broken "), key.cast("string")).alias("value")
    )
    out = started
    for part in (ended, done, ran, broken):
        out = out.unionByName(part)
    return out.withColumn("app", F.lit("app-1"))


# The same views for the SQL side.
CTE = {
    "ev": "SELECT event_id, ts, user_id, event_type, value,"
    " CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events",
    "pings": "SELECT l_orderkey AS order_id, l_linenumber AS part, l_suppkey AS robot, l_partkey AS item,"
    " CASE WHEN l_linestatus = 'O' THEN 'Edge' ELSE 'Cloud' END AS environment,"
    " o_orderdate AS source_ts, l_shipdate AS broker_ts,"
    " l_shipdate + l_linenumber * INTERVAL 1 DAY AS landing_ts"
    " FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "lats": "SELECT *, (epoch_us(broker_ts) - epoch_us(source_ts)) / 1e6 AS source_broker_latency,"
    " (epoch_us(landing_ts) - epoch_us(broker_ts)) / 1e6 AS broker_landing_latency,"
    " (epoch_us(landing_ts) - epoch_us(source_ts)) / 1e6 AS total_latency FROM pings",
    "lng": "SELECT environment, 'Kafka' AS stage, 1 AS stage_order, source_broker_latency AS latency FROM lats"
    " UNION ALL SELECT environment, 'Spark', 2, broker_landing_latency FROM lats"
    " UNION ALL SELECT environment, 'Total', 3, total_latency FROM lats",
    "samples": "SELECT event_id, ts AS timestamp, event_type AS series, 'w' || (user_id % 3) AS node,"
    " value AS raw FROM ev",
    "counters": "SELECT event_id, timestamp, series, node, raw,"
    " CAST(SUM(CAST(round(raw * 100) AS BIGINT)) OVER (PARTITION BY series, CAST(timestamp AS DATE)"
    " ORDER BY timestamp, event_id) AS DOUBLE) AS value FROM samples",
    "csamples": "SELECT event_id, ts AS timestamp, environment, pod,"
    " environment || '/' || pod || '/' || slot AS id, 'w' || slot AS node,"
    " CASE WHEN k % 10 <> 0 THEN CASE WHEN slot = 0 THEN 'broker' ELSE 'main' END END AS container,"
    " CASE WHEN k % 2 = 0 THEN 'orders' ELSE 'other' END AS topic, value AS raw"
    " FROM (SELECT *, user_id % 3 AS slot, CASE WHEN user_id % 2 = 0 THEN 'Edge' ELSE 'Cloud' END AS environment,"
    " CASE event_type WHEN 'view' THEN 'msg-bus-0' WHEN 'click' THEN 'msg-bus-1-fv5kx'"
    " WHEN 'signup' THEN 'blob-s3-0' WHEN 'purchase' THEN 'blob-fs-0' ELSE 'app-driver' END AS pod"
    " FROM ev)",
    "ccounters": "SELECT * EXCLUDE (raw), CAST(SUM(CAST(round(raw * 100) AS BIGINT)) OVER"
    " (PARTITION BY id, CAST(timestamp AS DATE) ORDER BY timestamp, event_id) AS DOUBLE) AS value FROM csamples",
    "cmem": "SELECT * EXCLUDE (raw), raw * 1e7 AS value FROM csamples",
    "limits": "SELECT * FROM (VALUES ('w0', 400.0::DOUBLE, 16.0::DOUBLE), ('w1', 400.0, 16.0),"
    " ('w2', 800.0, 40.0)) AS t(node, cpu_limit, mem_limit)",
    "phases": "SELECT event_id, ts AS timestamp, CASE user_id % 5"
    " WHEN 0 THEN 'etl-run-exec-' || user_id WHEN 1 THEN 'etl-run-' || user_id || '-driver'"
    " WHEN 2 THEN 'msg-bus-' || user_id WHEN 3 THEN 'blob-s3-' || user_id"
    " ELSE 'web-ui-' || user_id || '-abcdef1234' END AS pod,"
    " CASE user_id % 3 WHEN 0 THEN 'intake' WHEN 1 THEN 'batch' ELSE 'system' END AS namespace,"
    " CASE WHEN event_type IN ('view', 'click') THEN 'Running' WHEN event_type = 'signup' THEN 'Pending'"
    " WHEN event_type = 'error' THEN 'Failed' WHEN k % 3 = 0 THEN 'Evicted' ELSE 'Succeeded' END AS phase,"
    " CASE WHEN k % 7 = 0 THEN 0.0 ELSE 1.0 END AS value,"
    " CASE WHEN user_id % 2 = 0 THEN 'Edge' ELSE 'Cloud' END AS environment,"
    " 'w' || (user_id % 3) AS node FROM ev",
    "act": "SELECT * FROM phases WHERE value = 1",
    "raw_packets": "SELECT event_id AS packet_id, ts,"
    " CASE WHEN there THEN client ELSE broker END AS src_ip, CASE WHEN there THEN broker ELSE client END AS dst_ip,"
    " CASE WHEN there THEN port ELSE 9092 END AS sport, CASE WHEN there THEN 9092 ELSE port END AS dport,"
    " CASE WHEN k % 20 = 0 THEN 4 WHEN k % 20 < 3 THEN CASE WHEN there THEN 2 ELSE 18 END"
    " WHEN k % 20 < 10 THEN 16 ELSE 24 END AS tcp_flags,"
    " CASE WHEN k % 25 = 3 THEN 0 ELSE 64240 END AS window_size, k AS payload_len,"
    " CAST(floor(value) AS BIGINT) AS seq, event_id % 50 AS cid, there AS to_broker, broker,"
    " client AS client_ip, port AS client_port"
    " FROM (SELECT *, event_type IN ('view', 'click', 'signup') AS there,"
    " '10.1.' || (user_id // 256) || '.' || (user_id % 256) AS client,"
    " CASE WHEN event_id % 11 = 0 THEN '10.0.0.2' ELSE '10.0.0.1' END AS broker,"
    " CAST(40000 + user_id % 1000 AS INTEGER) AS port FROM ev)",
    "packets": "SELECT * FROM raw_packets WHERE broker = '10.0.0.1'",
    "k6": "SELECT event_id, ts, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS timestamp, CASE event_type"
    " WHEN 'view' THEN 'kafka_writer_wait_seconds' WHEN 'click' THEN 'kafka_writer_write_seconds'"
    " WHEN 'signup' THEN 'iteration_duration' WHEN 'purchase' THEN 'iterations'"
    " ELSE 'kafka_writer_error_count' END AS metric_name, value AS metric_value,"
    " CASE WHEN user_id % 2 = 0 THEN 'Edge' ELSE 'Cloud' END AS environment, user_id AS robot_id FROM ev",
    "ord": "SELECT *, epoch_ms(o_orderdate) + o_orderkey % 1000 AS started FROM orders",
    "jobs": "SELECT 'app-1' AS app, o_orderkey AS JobID, started AS SubmissionTime,"
    " CASE WHEN o_orderstatus <> 'P' THEN started + CAST(floor(o_totalprice) AS BIGINT) END AS CompletionTime,"
    " CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'F' THEN 'JobFailed' ELSE 'JobSucceeded' END AS JobResult,"
    " CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice) / 1000 END AS DurationSec FROM ord",
    "owners": "SELECT stage AS StageID, max(o_orderkey) AS JobID FROM"
    " (SELECT o_orderkey, unnest([o_orderkey * 2, o_orderkey * 2 + 1, o_orderkey * 2 + 2]) AS stage FROM orders)"
    " GROUP BY stage",
    "stages": "SELECT 'app-1' AS app, o_orderkey * 2 AS StageID, o_orderpriority AS StageName,"
    " started AS SubmissionTime, started + CAST(floor(o_totalprice / 2) AS BIGINT) AS CompletionTime,"
    " o_custkey % 50 AS NumTasks, (o_orderkey * 37) % 100003 AS ShuffleReadBytes,"
    " CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 11 ELSE 0 END AS ShuffleWriteBytes,"
    " o_custkey AS InputRecords, o_custkey * 2 AS OutputRecords, o_orderkey % 97 AS GCTimeMs,"
    " CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey ELSE 0 END AS DurationMs,"
    " floor(o_totalprice / 2) / 1000 AS DurationSec FROM ord",
}
NEEDS = {
    "lats": ["pings"],
    "lng": ["lats"],
    "samples": ["ev"],
    "counters": ["samples"],
    "csamples": ["ev"],
    "ccounters": ["csamples"],
    "cmem": ["csamples"],
    "phases": ["ev"],
    "act": ["phases"],
    "raw_packets": ["ev"],
    "packets": ["raw_packets"],
    "k6": ["ev"],
    "jobs": ["ord"],
    "stages": ["ord"],
}


def with_(*names: str, **more: str) -> str:
    """WITH clause of the named views and what they build on, then extra ones."""
    done: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in done:
            done.append(name)

    for n in names:
        add(n)
    parts = [f"{n} AS ({CTE[n]})" for n in done] + [f"{n} AS ({sql})" for n, sql in more.items()]
    return "WITH " + ", ".join(parts) + " "
