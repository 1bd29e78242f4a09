"""Hand-made rows for the cases that decide an operator's meaning."""

import datetime as dt
import gzip
import json
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch import schemas
from tidewatch.functions import naming as nm
from tidewatch.functions import timeutil as tm
from tidewatch.operators import drift, eventlog, filters, joins, latency, loadtest, metrics, network, pods
from tidewatch.plans import load_queries, views
from tidewatch.sources import avro, captures, sinks, tables
from tidewatch.streaming import pipeline

T0 = dt.datetime(2026, 1, 5, 12, 0, 0)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture(params=["wide", "narrow"])
def form(request, spark):
    """Slices as they are, and slices of one time or number each."""
    if request.param == "narrow":
        spark.conf.set("spark.tidewatch.sliceSeconds", "0.001")
        spark.conf.set("spark.tidewatch.sliceNumbers", "1")
    yield request.param
    spark.conf.unset("spark.tidewatch.sliceSeconds")
    spark.conf.unset("spark.tidewatch.sliceNumbers")


def test_counter_policies(spark, form):
    # first sample, increase, reset, unchanged, same time twice; a series of one sample
    rows = [("a", at(0), 10.0), ("a", at(5), 20.0), ("a", at(10), 4.0), ("a", at(15), 4.0), ("a", at(15), 6.0)]
    df = spark.createDataFrame(rows + [("b", at(0), 1.0)], "s string, t timestamp, v double")

    def rates(**how):
        out = metrics.counter_rate(df, ["s"], "t", "v", tie=["v"], **how)
        return sorted((r.s, r.t, r.v, r.rate) for r in out.collect())

    full = [r[3] for r in rates()]
    assert full == [None, 2.0, 0.8, 0.0, None, None]
    assert [r[3] for r in rates(zero_gap="one")] == [None, 2.0, 0.8, 0.0, 2.0, None]
    assert [r[3] for r in rates(policy="drop_reset", zero_gap="drop")] == [2.0, 0.0]
    assert [r[3] for r in rates(policy="drop_nonpositive", zero_gap="drop")] == [2.0]
    assert [r[3] for r in rates(per_second=False)] == [None, 10.0, 4.0, 0.0, 2.0, None]
    with pytest.raises(ValueError):
        rates(policy="other")


def test_resample_edges_and_gaps(spark):
    rows = [(at(0), 1.0), (at(29), 3.0), (at(30), 5.0), (at(95), 7.0)]
    df = spark.createDataFrame(rows, "t timestamp, v double").withColumn("s", F.lit("x"))
    got = {r.bucket: r.v for r in metrics.resample(df, "t", 30, ["s"], "v", fill=True).collect()}
    assert got == {at(0): 2.0, at(30): 5.0, at(60): None, at(90): 7.0}
    with pytest.raises(ValueError):
        metrics.resample(df, "t", 7, ["s"], "v")


def test_rolling_mean_starts_short(spark, form):
    df = spark.createDataFrame([(at(i), float(v)) for i, v in enumerate([3, 6, 9, 12])], "t timestamp, v double")
    out = metrics.rolling_mean(df.withColumn("s", F.lit(1)), ["s"], ["t"], "v").orderBy("t").collect()
    assert [r.smoothed for r in out] == [3.0, 4.5, 6.0, 9.0]


def test_interval_gap_is_strict(spark, form):
    times = [0, 45, 91, 92, 200]
    df = spark.createDataFrame([("p", at(s), "n") for s in times], "pod string, timestamp timestamp, namespace string")
    out = pods.running_intervals(df, origin=T0).orderBy("start_ts").collect()
    assert [(r.start_offset_s, r.duration_s) for r in out] == [(0.0, 45.0), (91.0, 30.0), (200.0, 30.0)]
    gaps = pods.scrape_gaps(df.withColumn("environment", F.lit("e"))).orderBy("gap_start").collect()
    assert [r.duration_s for r in gaps] == [46.0, 108.0]


def phase_rows(spark, phases, pod="app-driver"):
    rows = [(pod, at(i * 10), p, 1.0) for i, p in enumerate(phases)]
    return spark.createDataFrame(rows, "pod string, timestamp timestamp, phase string, value double")


def test_segments_and_restarts(spark, form):
    df = phase_rows(spark, ["Pending", "Running", "Running", "Pending", "Pending", "Running", "Failed", "Pending"])
    segments = pods.phase_segments(df).orderBy("segment").collect()
    assert [(r.phase, r.samples) for r in segments] == [
        ("Pending", 1),
        ("Running", 2),
        ("Pending", 2),
        ("Running", 1),
        ("Failed", 1),
        ("Pending", 1),
    ]
    restarts = pods.restarts(df).orderBy("restart_time").collect()
    assert [(r.restart_time, r.running_time) for r in restarts] == [(at(30), at(50)), (at(70), None)]


@pytest.mark.parametrize(
    ("phases", "start"),
    [
        (["Pending", "Running", "Running"], 10),
        (["Running", "Odd", "Failed"], 0),
        (["Running", "Odd"], None),
        (["Running", "Odd", "Running"], 20),
        (["Pending"], None),
    ],
)
def test_true_starts(spark, phases, start):
    got = [r.start_ts for r in pods.true_starts(phase_rows(spark, phases)).collect()]
    assert got == ([] if start is None else [at(start)])


def test_warmup_and_labels(spark):
    rows = [("app-driver", 0), ("app-exec-2", 30), ("app-exec-10", 50), ("app-exec-10", 90), ("other", 1)]
    df = spark.createDataFrame([("Edge", p, at(s), "Running", 1.0) for p, s in rows],
                               "environment string, pod string, timestamp timestamp, phase string, value double")
    assert pods.warmup(df).collect()[0].warmup_s == 50.0
    late = df.where("pod <> 'app-driver'").unionByName(
        df.where("pod = 'app-driver'").withColumn("timestamp", F.lit(at(60)))
    )
    assert pods.warmup(late).collect()[0].warmup_s is None
    labels = {r.pod: r.label for r in pods.role_labels(df).collect()}
    assert labels == {
        "app-driver": "spark-driver",
        "app-exec-2": "spark-worker-1",
        "app-exec-10": "spark-worker-2",
        "other": "other",
    }


def test_names(spark):
    cases = {
        "app-6b6bf85947-b67tc": ("app", "app-6b6bf85947-b67tc"),
        "a-b-c-d": ("a-b-c", "a-b-c-d"),
        "x-exec-12": ("x-exec-12", "spark-executor-12"),
        "bus-broker-2": ("b-2", "broker"),
        "bus-1-zk": ("b-1-zk", "broker"),
    }
    df = spark.createDataFrame([(p,) for p in cases], "pod string")
    for r in df.select("pod", nm.short_name("pod", {"bus": "b"}).alias("s"), nm.component_name("pod", {"bus": "broker"}).alias("c")).collect():
        assert (r.s, r.c) == cases[r.pod]


def test_timestamps(spark):
    rows = ["2025-12-26T17:03:06", "2025-12-26T17:03:06.5+00:00", "2025-12-26 14:03:06-03:00", "1766768586000", "x"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = [r.u for r in df.select(tm.normalize_ts("t", "any").alias("u")).collect()]
    base = dt.datetime(2025, 12, 26, 17, 3, 6)
    assert got == [base, base.replace(microsecond=500_000), base, base, None]
    text = spark.range(1).select(*[tm.format_duration(F.lit(s)).alias(f"c{i}") for i, s in enumerate([5.25, 65.0, 3723.4])])
    assert list(text.collect()[0]) == ["5.3s", "1m05.0s", "1h02m03.4s"]


def test_headers(spark):
    rows = [
        (1, [("sent_at", b"5"), ("robot_id", b"r1")]),
        (2, [("sent_at", b"5"), ("sent_at", b"6")]),
        (3, [("sent_at", b"abc")]),
        (4, []),
        (5, None),
    ]
    df = spark.createDataFrame(rows, "id int, headers array<struct<key: string, value: binary>>")
    got = {r.id: r.v for r in df.select("id", avro.header_value("headers", "sent_at", "long").alias("v")).collect()}
    assert got == {1: 5, 2: 6, 3: None, 4: None, 5: None}


def test_record_codec_round_trip(spark):
    schema = schemas.record_schema("robot_data")
    struct_type = schemas.avro_to_struct(schema)
    assert len(struct_type) == 87 and struct_type["source_timestamp"].dataType == T.LongType()
    cols = [((F.col("id") * (i + 1)) / 8).cast("float").alias(c) for i, c in enumerate(schemas.FAMILIES["robot_data"])]
    stamp = (F.col("id") * 1_000_003 - 2_000_000_000_000).alias("source_timestamp")
    df = spark.range(500).select("id", F.struct(*cols, stamp).alias("record"))
    framed = df.withColumn("value", avro.encode_framed("record", schema, 12))
    assert framed.select(F.hex(F.substring("value", 1, 5))).first()[0] == "000000000C"
    back = avro.decode_framed(framed, "value", schema)
    assert back.where("record = parsed_value").count() == 500
    wide = avro.decode_framed(framed, "value", schema, widen=True)
    assert wide.schema["parsed_value"].dataType["voltage"].dataType == T.DoubleType()
    text = schemas.record_schema("control_power", "string")
    one = [F.lit(1.5).cast("float").alias(c) for c in schemas.POWER_COLUMNS] + [F.lit("é2025").alias("source_timestamp")]
    rows = spark.range(3).select(F.struct(*one).alias("r")).withColumn("value", avro.encode_framed("r", text, 1))
    assert {r.t for r in avro.decode_framed(rows, "value", text).select("parsed_value.source_timestamp").toDF("t").collect()} == {"é2025"}


def test_broken_records(spark):
    schema = schemas.TEMPERATURE_SCHEMA
    good = avro.encode_row([5, 1.5], [("source_timestamp", "long"), ("temperature", "double")], 1)
    df = spark.createDataFrame([(good,), (good[:-3],), (None,)], "value binary")
    got = avro.decode_framed(df, "value", schema, mode="PERMISSIVE").select("parsed_value").collect()
    assert [r[0] is None for r in got] == [False, True, True]
    with pytest.raises(Exception, match="ends before"):
        avro.decode_framed(df, "value", schema).collect()
    with pytest.raises(ValueError, match="unsupported"):
        schemas.avro_to_struct('{"fields": [{"name": "x", "type": ["null", "int"]}]}')


def test_conform_and_family(spark):
    df = spark.createDataFrame([(1, "2.5")], "a int, b string")
    shape = T.StructType().add("a", T.LongType()).add("b", T.DoubleType()).add("c", T.StringType())
    assert list(schemas.conform(df, shape, {"c": "z"}).first()) == [1, 2.5, "z"]
    with pytest.raises(ValueError, match="missing"):
        schemas.conform(df, shape)
    with pytest.raises(ValueError):
        schemas.select_family(df, "nothing")
    wide = spark.range(1).select(*[F.lit(0).alias(c) for c in schemas.FAMILIES["robot_data"]])
    assert len(schemas.select_family(wide, "accelerometer_gyro").columns) == 77


def packet(spark, rows):
    cols = "packet_id bigint, ts timestamp, there boolean, cid bigint, payload_len int, seq bigint, tcp_flags int, client string"
    df = spark.createDataFrame([(i, at(r[0]), *r[1:]) for i, r in enumerate(rows)], cols)
    return df.select(
        "packet_id",
        "ts",
        F.when(F.col("there"), F.col("client")).otherwise("b").alias("src_ip"),
        F.when(F.col("there"), F.lit("b")).otherwise(F.col("client")).alias("dst_ip"),
        F.when(F.col("there"), 5000).otherwise(9092).alias("sport"),
        F.when(F.col("there"), 9092).otherwise(5000).alias("dport"),
        "tcp_flags",
        F.lit(1).alias("window_size"),
        "payload_len",
        "seq",
        "cid",
    )


def test_request_matching(spark, form):
    rows = [
        (0, True, 1, 20, 1, 24, "x"),  # superseded by the next request
        (1, True, 1, 20, 2, 24, "x"),
        (2, True, 1, 20, 3, 24, "y"),  # same id, other connection
        (3, False, 1, 20, 1, 24, "x"),
        (4, False, 1, 20, 2, 24, "x"),  # already answered
        (5, False, 1, 12, 3, 24, "y"),  # payload too short
    ]
    df = network.to_broker(packet(spark, rows), "b", 9092)
    got = [(r.packet_id, r.broker_latency_ms) for r in network.match_requests(df).collect()]
    assert got == [(3, 1000.0)]
    flow = network.match_requests(df, ("client_ip", "client_port", "cid")).collect()
    assert [(r.packet_id, r.broker_latency_ms) for r in flow] == [(3, 2000.0)]


def test_handshake_jitter_retransmission(spark, form):
    rows = [
        (0.0, True, None, 0, 1, 2, "x"),  # SYN
        (0.5, False, None, 0, 1, 18, "x"),  # SYN-ACK
        (0.6, False, None, 0, 1, 18, "x"),  # repeated SYN-ACK
        (0.7, True, None, 0, 1, 16, "x"),  # plain ACK
        (0.9, False, None, 5, 7, 24, "x"),
        (3.0, False, None, 5, 7, 24, "x"),  # same sequence again, long gap before
        (3.1, False, None, 5, 8, 28, "x"),
    ]
    df = network.to_broker(packet(spark, rows), "b", 9092)
    assert [r.rtt_ms for r in network.rtt(df).collect()] == [500.0]
    shake = network.jitter(df).collect()[0]
    assert shake.gaps == 3 and shake.jitter_ms == pytest.approx(200.0)
    table = {r.packet_id: r for r in network.packet_table(df).collect()}
    assert [table[i].is_retransmission for i in range(7)] == [0, 0, 0, 0, 0, 1, 0]
    assert table[1].rtt_ms == 500.0
    report = network.network_report(df).collect()[0]
    assert (report.packets, report.resets, report.retransmissions) == (7, 1, 1)


def pcap_bytes(packets, order="<"):
    out = [struct.pack(order + "IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)]
    for us, src, dst, sport, dport, seq, flags, payload in packets:
        tcp = struct.pack(">HHIIBBHHH", sport, dport, seq, 0, 0x50, flags, 100, 0, 0) + payload
        ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(tcp), 0, 0, 64, 6, 0, bytes(src), bytes(dst))
        frame = b"\0" * 12 + b"\x08\0" + ip + tcp
        out.append(struct.pack(order + "IIII", us // 1_000_000, us % 1_000_000, len(frame), len(frame)) + frame)
    return b"".join(out)


def test_captures(spark, tmp_path):
    a, b = (10, 0, 0, 1), (10, 0, 0, 2)
    first = [
        (1_000_000, a, b, 5000, 9092, 1, 24, b"\0" * 8 + struct.pack(">I", 77) + b"tail"),
        (1_500_000, b, a, 9092, 5000, 9, 24, b"\0" * 4 + struct.pack(">I", 77) + b"longer"),
        (1_600_000, b, a, 9092, 5000, 15, 16, b""),
    ]
    (tmp_path / "run_capture_20260105_120000.pcap").write_bytes(pcap_bytes(first))
    (tmp_path / "run_capture_20260105_130000.pcap").write_bytes(pcap_bytes(first[:1], ">"))
    (tmp_path / "notes.txt").write_text("x")
    files = captures.read_captures(spark, str(tmp_path))
    rows = captures.with_cid(captures.decode_captures(files), 9092).orderBy("file", "packet_no").collect()
    assert [(r.packet_no, r.cid, r.payload_len) for r in rows] == [(0, 77, 16), (1, 77, 14), (2, None, 0), (0, 77, 16)]
    assert rows[0].ts == dt.datetime(1970, 1, 1, 0, 0, 1) and rows[0].src_ip == "10.0.0.1"
    early = captures.read_captures(spark, str(tmp_path), end=dt.datetime(2026, 1, 5, 12, 30))
    assert captures.decode_captures(early).count() == 3
    matched = network.match_requests(
        network.to_broker(captures.with_cid(captures.decode_captures(early), 9092), "10.0.0.2", 9092)
    )
    assert [r.broker_latency_ms for r in matched.collect()] == [500.0]


def test_own_event_log(spark, tmp_path):
    spark.range(1000).repartition(3).groupBy(F.col("id") % 5).count().collect()
    lines = tables.read_event_log(spark, spark.event_logs)
    jobs = eventlog.jobs(lines).where("CompletionTime is not null")
    assert jobs.where("JobResult = 'JobSucceeded' and DurationSec >= 0").count() > 0
    stages = eventlog.stages(lines).where("JobID is not null")
    assert stages.where("NumTasks > 0 and ShuffleWriteBytes > 0").count() > 0
    assert eventlog.tasks(lines).where("Successful and Duration >= 0").count() > 0


def test_event_logs_of_equal_names_and_rolled_ones(spark, tmp_path):
    """Applications are told apart by their start event; a rolled log is one application."""

    def line(**event):
        return json.dumps(event)

    def job(i, ms):
        start = line(Event="SparkListenerJobStart", **{"Job ID": i, "Submission Time": 0, "Stage Infos": [{"Stage ID": i}]})
        return start, line(Event="SparkListenerJobEnd", **{"Job ID": i, "Completion Time": ms, "Job Result": {"Result": "JobSucceeded"}})

    def app(name, attempt=None):
        more = {} if attempt is None else {"App Attempt ID": attempt}
        return line(Event="SparkListenerApplicationStart", **{"App Name": "x", "App ID": name, **more})

    def write(path, *lines):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("\n".join(lines) + "\n")

    a, b, c = job(1, 1000), job(1, 2000), job(1, 3000)
    write("one/eventLogs.json", app("app-a"), *a)
    write("two/eventLogs.json", app("app-b", "2"), *b)
    write("three/plain", *c)
    # the end of job 7 is in the second file of the log, which has no start event
    r = job(7, 7000)
    write("eventlog_v2_app-r/events_1_app-r", app("app-r"), r[0])
    write("eventlog_v2_app-r/events_2_app-r", r[1])
    write("eventlog_v2_app-r/appstatus_app-r", "")
    lines = tables.read_event_log(spark, str(tmp_path))
    got = {r["app"].rsplit("/", 1)[-1]: (r["JobID"], r["DurationSec"]) for r in eventlog.jobs(lines).collect()}
    assert got == {"app-a": (1, 1.0), "app-b_2": (1, 2.0), "plain": (1, 3.0), "app-r": (7, 7.0)}
    whole = eventlog.history(lines)
    jobs = {r["app"].rsplit("/", 1)[-1]: (r["ID"], r["DurationSec"]) for r in whole.where("Kind = 'job'").collect()}
    assert jobs == got and whole.where("Kind = 'stage'").count() == 0


def test_history_reads_its_lines_once(spark, tmp_path):
    spark.createDataFrame([("a", "{}")], "app string, value string").write.parquet(str(tmp_path / "lines"))
    lines = spark.read.parquet(str(tmp_path / "lines"))
    plan = eventlog.history(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan


def test_event_log_edge_cases(spark):
    def line(**event):
        return json.dumps(event)

    start = {"Event": "SparkListenerJobStart", "Submission Time": 1000}
    rows = [
        line(**start, **{"Job ID": 1, "Stage Infos": [{"Stage ID": 1}, {"Stage ID": 2}]}),
        line(**start, **{"Job ID": 2, "Stage Infos": [{"Stage ID": 2}]}),
        line(Event="SparkListenerJobEnd", **{"Job ID": 1, "Completion Time": 3500, "Job Result": {"Result": "JobSucceeded"}}),
        line(Event="SparkListenerStageCompleted", **{"Stage Info": {"Stage ID": 2, "Submission Time": 1, "Completion Time": 2001, "Accumulables": [{"Name": "duration", "Value": "12"}, {"Name": "internal.metrics.input.recordsRead", "Value": 5}]}}),
        "",
        "{oops SparkListenerJobStart",
    ]
    lines = spark.createDataFrame([("a", r) for r in rows], "app string, value string")
    jobs = {r.JobID: r for r in eventlog.jobs(lines).collect()}
    assert jobs[1].DurationSec == 2.5 and jobs[2].CompletionTime is None
    stage = eventlog.stages(lines).collect()[0]
    assert (stage.JobID, stage.DurationMs, stage.InputRecords, stage.OutputRecords) == (2, 12, 5, 0)
    assert stage.StageName == "unknown" and stage.DurationSec == 2.0
    assert [r.line for r in eventlog.bad_lines(lines).collect()] == [rows[-1]]


def test_host_and_load_files(spark, tmp_path):
    head = "r,b,swpd,free,buff,cache,si,so,bi,bo,in,cs,us,sy,id,wa,st,timestamp\n"
    (tmp_path / "edge.csv").write_text(
        "# TOTAL_MEM_KB: 1000\n" + head + "0, 0,0,500,100,100,0,0,0,0,1,1,1,0, 90,0,0,2026-01-04 15:30:00\n"
    )
    (tmp_path / "cloud.csv").write_text("# TOTAL_MEM_KB: 0\n" + head + "0,0,0,5,1,1,0,0,0,0,1,1,1,0,40,0,0,2026-01-04 15:30:05\n")
    rows = metrics.host_usage(tables.read_vmstat(spark, str(tmp_path))).orderBy("timestamp").collect()
    assert [(r.cpu_usage, r.mem_usage) for r in rows] == [(10.0, 30.0), (60.0, 0.0)]
    assert rows[0].timestamp == dt.datetime(2026, 1, 4, 15, 30)
    with gzip.open(tmp_path / "k6.csv.gz", "wt") as f:
        f.write("metric_name,timestamp,metric_value,extra\nwait,100,0.5,a\nwait,100,1.5,\nother,101,9,b\n")
    load = tables.read_loadtest_csv(spark, str(tmp_path / "k6.csv.gz"), spread=3)
    got = {r.stat: r.metric_value for r in loadtest.per_second(load, "wait").collect()}
    assert got == {"min_val": 0.5, "mean_val": 1.0, "max_val": 1.5}


def test_slo_without_samples_passes(spark):
    df = spark.createDataFrame([("kafka_writer_wait_seconds", 0.15)], "metric_name string, metric_value double")
    got = {(r.metric_name, r.stat): r.passed for r in loadtest.check_slo(df).collect()}
    assert got == {
        ("dropped_iterations", "count"): True,
        ("kafka_writer_error_count", "count"): True,
        ("kafka_writer_write_seconds", "p95"): True,
        ("kafka_writer_wait_seconds", "p95"): False,
        ("kafka_writer_wait_seconds", "p99"): True,
    }


def test_replay_cycles(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "x string, seq bigint")
    out = loadtest.replay(df, "seq", robots=2, freq=10, start=T0, seconds=0.5)
    got = sorted((r.robot_id, r.message, r.x, r.source_timestamp) for r in out.collect())
    assert [g[2] for g in got[:5]] == ["a", "b", "c", "a", "b"] and len(got) == 10
    assert got[4][3] == at(0.4)


def test_interval_statistics(spark, form):
    df = spark.createDataFrame([(1, at(s)) for s in (0, 1, 3, 7)] + [(2, at(0))], "robot int, t timestamp")
    rows = loadtest.interval_stats(df, ["robot"], "t").collect()
    assert len(rows) == 1 and rows[0]["count"] == 3
    assert rows[0].median == 2.0 and rows[0].std == pytest.approx(1.247219, abs=1e-6)


def test_drift_finds_brokers(spark):
    rows = [(b, 35.28 + b * 500.0 + (i % 21 - 10) * 0.5) for b in range(3) for i in range(400)]
    df = spark.createDataFrame(rows, "broker int, drift_ms double")
    labelled = drift.assign_clusters(df, drift.fit_drift(df, seeds=3))
    assert labelled.select("broker", "cluster").distinct().count() == 3
    fixed = drift.compensate(labelled)
    assert fixed.agg(F.max(F.abs(F.col("corrected_ms") - 35.28))).first()[0] <= 5.0 + 1e-9
    assert drift.iqr(fixed, "corrected_ms").first()[0] == pytest.approx(5.0, abs=0.6)


def test_latency_long_needs_its_columns(spark):
    with pytest.raises(ValueError, match="missing columns"):
        latency.latency_long(spark.range(1))


def test_missing_environment_is_zero(spark):
    df = spark.createDataFrame([("Edge", "Kafka", 1, 0.5)], "environment string, stage string, stage_order int, latency double")
    wide = latency.latency_summary_wide(latency.latency_summary(df), fill=0.0).collect()[0]
    assert wide.median_edge_ms == 500.0 and wide.median_cloud_ms == 0.0


def test_trim_bounds(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "v double")
    closed = filters.trim_quantiles(df, {"v": (0.05, 0.95)})
    open_low = filters.trim_quantiles(df, {"v": (0.05, 0.95)}, lo_strict=True)
    assert (closed.count(), open_low.count()) == (91, 90)
    assert list(filters.trim_report(df, "v", None, 0.95).first()) == [101, 96, 5]


def test_range_json_and_metric_files(spark, tmp_path):
    series = {"metric": {"__name__": "m1", "pod": "p"}, "values": [[1000.5, "1.5"], [1005, "NaN"]]}
    (tmp_path / "m.json").write_text(json.dumps([series, {"metric": {"__name__": "m2"}, "values": [[7, "2"]]}]))
    raw = spark.read.text(str(tmp_path / "m.json"), wholetext=True)
    rows = tables.flatten_range_json(raw, labels=["pod"])
    got = sorted((r.metric, r.timestamp, r.pod) for r in rows.collect())
    assert got[0] == ("m1", dt.datetime(1970, 1, 1, 0, 16, 40, 500_000), "p") and len(got) == 3
    sinks.write_metrics(rows, str(tmp_path / "store"))
    assert tables.read_metric(spark, str(tmp_path / "store"), "m*").count() == 3
    assert tables.first_metric(spark, str(tmp_path / "store"), "m*").select("metric").distinct().collect()[0][0] == "m1"
    plan = tables.read_metric(spark, str(tmp_path / "store"), "m1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(metric" in plan


def test_table_helpers(spark, tmp_path):
    shape = T.StructType().add("a", T.LongType()).add("b", T.StringType())
    sinks.create_empty(spark, shape, str(tmp_path / "empty"))
    assert spark.read.schema(shape).parquet(str(tmp_path / "empty")).count() == 0
    df = spark.range(10).select(F.col("id").alias("a"), F.lit("x").alias("b"))
    sinks.export_rows(df, ["a"], str(tmp_path / "t"), max_rows=4)
    detail = sinks.table_detail(spark, str(tmp_path / "t")).collect()[0]
    assert detail.rows == 4 and detail.bytes > 0
    assert [r.type for r in sinks.describe_table(df).orderBy("position").collect()] == ["bigint", "string"]
    sinks.write_acks(spark.createDataFrame([(1, 2, 0.5)], "source_timestamp bigint, robot_id bigint, ack_latency double"), str(tmp_path / "acks"))
    assert spark.read.parquet(str(tmp_path / "acks")).schema["robot_id"].dataType == T.IntegerType()
    assert tables.read_concat(spark, [str(tmp_path / "t"), str(tmp_path / "t")]).count() == 8


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    schema = schemas.TEMPERATURE_SCHEMA
    record = F.struct(F.col("id").alias("source_timestamp"), (F.col("id") / 4).alias("temperature"))

    def batch(lo, hi):
        rows = avro.to_topic(spark.range(lo, hi).withColumn("r", record), "id", "r", schema, 1, "t", {"sent_at": F.col("id")})
        full = rows.withColumns({"partition": F.lit(0), "offset": F.lit(0).cast("long"), "timestamp": F.lit(T0), "timestampType": F.lit(1)})
        full.select("key", "value", "topic", "partition", "offset", "timestamp", "timestampType", "headers").write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        source = tables.read_stream(spark, "parquet", str(tmp_path / "in"), schemas.TOPIC_SCHEMA, max_per_trigger=1)
        q = pipeline.run_ingest(spark, source, schema, str(tmp_path / "raw"), str(tmp_path / "cp"), fmt="parquet", trigger="availableNow")
        q.awaitTermination()
        return q

    batch(0, 50)
    query = run()
    assert pipeline.progress_rows(spark, query).agg(F.sum("input_rows")).first()[0] == 50
    batch(50, 80)
    run()
    raw = spark.read.parquet(str(tmp_path / "raw"))
    assert sorted(r[0] for r in raw.select("parsed_value.source_timestamp").collect()) == list(range(80))
    assert raw.where("sent_at_ts = parsed_value.source_timestamp").count() == 80
    again = pipeline.ingest(spark.read.parquet(str(tmp_path / "in")), schema)
    cols = ["topic", "timestamp", "sent_at_ts", "parsed_value"]
    assert again.select(*cols).exceptAll(raw.select(*cols)).count() == 0
    changes = tables.read_stream(spark, "parquet", str(tmp_path / "raw"), raw.schema)
    shown = sinks.write_stream(pipeline.change_view(changes), "memory", None, str(tmp_path / "cp2"), name="shown", trigger="availableNow")
    shown.awaitTermination()
    assert spark.table("shown").columns == ["kafka_timestamp", "spark_timestamp"] and spark.table("shown").count() == 80


def test_triggers_and_stamps(spark, tmp_path):
    """A stream on a clock, and views and stamps on the way."""
    spark.range(20).write.parquet(str(tmp_path / "in"))
    source = tables.read_stream(spark, "parquet", str(tmp_path / "in"), "id long")
    running = sinks.write_stream(source, "parquet", str(tmp_path / "out"), str(tmp_path / "cp"), trigger="1 second")
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20
    seen = tables.as_view(tm.stamp_source(tm.stamp_source(spark.range(3), name="ms"), "iso", "text"), "stamped")
    row = spark.sql("select count(distinct ms) n, min(text) t, min(ms) ms from stamped").first()
    assert seen.count() == 3 and row.n == 1 and row.t.startswith("20") and row.ms > 1_600_000_000_000
    rows = spark.createDataFrame([("a",), ("b",), ("a",)], "_measurement string")
    assert sorted(r[0] for r in tables.measurements(rows).collect()) == ["a", "b"]


def test_numbers_within_groups(spark):
    """Row numbers of a range sort, one group holding most rows."""
    rows = [("hot" if i % 10 else None, (i * 7919) % 1009, i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, x int, id int").repartition(5)
    got = {r["id"]: r["rank"] for r in pods.numbered(df, ["g"], [F.col("x"), F.col("id")]).collect()}
    for g in ("hot", None):
        own = sorted((x, i) for k, x, i in rows if k == g)
        assert [got[i] for _, i in own] == list(range(1, len(own) + 1))


def test_rows_without_drift_keep_a_null_cluster(spark):
    rows = [(i, float(i % 2) * 100 + i * 0.01) for i in range(60)] + [(60, None), (61, float("nan"))]
    df = spark.createDataFrame(rows, "id long, drift_ms double")
    got = {r["id"]: r["cluster"] for r in drift.assign_clusters(df, drift.fit_drift(df, k=2, seeds=2)).collect()}
    assert len(got) == 62 and got[60] is None and got[61] is None
    assert len({got[i] for i in range(0, 60, 2)}) == 1 and got[0] != got[1]


def test_drift_is_fitted_over_a_part_per_core(spark, monkeypatch):
    parts, fit = [], drift.GaussianMixture.fit
    monkeypatch.setattr(drift.GaussianMixture, "fit", lambda self, df: parts.append(df.rdd.getNumPartitions()) or fit(self, df))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(float(i % 2) * 100 + i * 0.01,) for i in range(200)], "drift_ms double")
        model = drift.fit_drift(df, k=2, seeds=2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts == [spark.sparkContext.defaultParallelism] * 2 and len(model.gaussians) == 2


def test_joined_lines_come_in_parts(spark, tmp_path, monkeypatch):
    """A task of the join takes a share of the rows that their number and no setting fixes."""
    rows = spark.range(4000)
    day = "CAST(DATE'2026-01-01' AS TIMESTAMP)"
    rows.selectExpr(
        "id DIV 4 AS l_orderkey", "id % 4 + 1 AS l_linenumber", "id AS l_suppkey", "id AS l_partkey", "'O' AS l_linestatus", f"{day} AS l_shipdate"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows.where("id < 900").selectExpr("id AS o_orderkey", f"{day} AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    whole = views.pings(spark, str(tmp_path)).collect()
    monkeypatch.setattr(views, "PART_ROWS", 100)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = views.pings(spark, str(tmp_path))
        sizes = df.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(whole) == 3600 and sorted(df.collect()) == sorted(whole)
    assert len(sizes) > 30 and max(r["count"] for r in sizes) < 400


def test_events_are_parsed_once_for_jobs_and_stages(spark, tmp_path):
    start = {"Event": "SparkListenerJobStart", "Submission Time": 1000, "Job ID": 1, "Stage Infos": [{"Stage ID": 2}]}
    done = {"Event": "SparkListenerStageCompleted", "Stage Info": {"Stage ID": 2, "Submission Time": 1, "Completion Time": 2001}}
    values = [json.dumps(start), json.dumps(done), "{oops SparkListenerJobStart", json.dumps({"Event": "SparkListenerTaskEnd"})]
    spark.createDataFrame([("a", x) for x in values], "app string, value string").write.parquet(str(tmp_path / "lines"))
    lines = spark.read.parquet(str(tmp_path / "lines"))
    parsed = eventlog.kept_events(lines, ["SparkListenerJobStart", "SparkListenerJobEnd", "SparkListenerStageCompleted"])
    for rows in (eventlog.jobs, eventlog.stages, eventlog.stage_to_job):
        assert rows(parsed).collect() == rows(lines).collect()
        assert "from_json" not in rows(parsed)._jdf.queryExecution().optimizedPlan().toString()


def test_history_and_its_mean_collect_no_lists(spark, tmp_path):
    start = {"Event": "SparkListenerJobStart", "Submission Time": 1000, "Job ID": 1, "Stage Infos": [{"Stage ID": 2}]}
    stage = {"Stage ID": 2, "Submission Time": 1, "Completion Time": 2001}
    again = {**stage, "Stage Attempt ID": 1, "Completion Time": 4001}
    values = [json.dumps(start)] + [json.dumps({"Event": "SparkListenerStageCompleted", "Stage Info": x}) for x in (stage, again, again)]
    spark.createDataFrame([("a", x) for x in values], "app string, value string").write.parquet(str(tmp_path / "lines"))
    history = eventlog.history(spark.read.parquet(str(tmp_path / "lines")))
    assert sorted((r.Kind, r.ID, r.Attempt or 0, r.JobID, r.DurationSec) for r in history.collect()) == [
        ("job", 1, 0, 1, None), ("stage", 2, 0, 1, 2.0), ("stage", 2, 1, 1, 4.0), ("stage", 2, 1, 1, 4.0)
    ]
    assert "collect_list" not in history._jdf.queryExecution().optimizedPlan().toString()
    series = eventlog.stage_series(history)
    plan = series._jdf.queryExecution().optimizedPlan().toString()
    assert "parse_json" not in plan and {r.MeanSec for r in series.collect()} == {10 / 3}


def test_event_files_are_written_without_a_sort(spark, tmp_path):
    rows = [(i, dt.datetime(2026, 1, 1), i, ["a", "b", "", None][i % 4], 1.0, '{"k": 1}') for i in range(40)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
    df.write.parquet(str(tmp_path / "events.parquet"))
    load_queries._event_files(spark, str(tmp_path), str(tmp_path / "in"))
    files = spark.read.parquet(str(tmp_path / "in")).groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n"), F.collect_set("event_type").alias("t"))
    assert sorted((r.n, r.t) for r in files.collect()) == [(10, []), (10, [""]), (10, ["a"]), (10, ["b"])]
