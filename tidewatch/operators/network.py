"""Broker traffic from packet rows (NET).

Packet rows have ts, src_ip, dst_ip, sport, dport, tcp_flags, window_size,
payload_len, seq, cid (correlation id, null if the payload is too short) and
packet_id as tie-breaker for packets captured at the same time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.timeutil import micros
from tidewatch.operators.ordered import Ordered
from tidewatch.operators.quantiles import exact_quantiles

# TCP flag bits, and the payload length a request header needs more than.
RST, SYN, SYN_ACK = 0x04, 0x02, 0x12
HEADER_BYTES = 12
FLOW = ["src_ip", "dst_ip", "sport", "dport"]


def to_broker(df: DataFrame, ip: str, port: int, start=None, end=None) -> DataFrame:
    """Packets to or from the broker in a time window, with direction and client endpoint."""
    there = (F.col("dst_ip") == ip) & (F.col("dport") == port)
    back = (F.col("src_ip") == ip) & (F.col("sport") == port)
    if start is not None:
        df = df.where(F.col("ts") >= F.lit(start))
    if end is not None:
        df = df.where(F.col("ts") <= F.lit(end))
    return df.where(there | back).withColumns(
        {
            "to_broker": there,
            "client_ip": F.when(there, F.col("src_ip")).otherwise(F.col("dst_ip")),
            "client_port": F.when(there, F.col("sport")).otherwise(F.col("dport")),
        }
    )


def _is_reset():
    return F.col("tcp_flags").bitwiseAND(RST) != 0


def tcp_health(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Packets, connection resets and closed receive windows."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("packets"),
        F.count_if(_is_reset()).alias("resets"),
        F.count_if(F.col("window_size") == 0).alias("zero_windows"),
    )


def mark_retransmissions(df: DataFrame) -> DataFrame:
    """`is_retransmission`: payload whose sequence number was seen before in its flow."""
    keyed = df.withColumn("_seq", F.when(F.col("payload_len") > 0, F.col("seq")))
    o = Ordered(keyed, [*FLOW, "_seq"], ["ts", "packet_id"]).lag(["ts"])
    again = F.col("_seq").isNotNull() & F.col("_prev1").isNotNull()
    return o.result().withColumn("is_retransmission", again.cast("int")).drop("_seq", "_prev1")


def retransmissions(df: DataFrame, by: Sequence[str] = FLOW) -> DataFrame:
    """Retransmitted packets per flow: payload packets less distinct sequence numbers."""
    sent = df.where(F.col("payload_len") > 0)
    per_seq = sent.groupBy(*FLOW, "seq").agg(F.count(F.lit(1)).alias("_n"))
    return per_seq.groupBy(*by).agg(
        F.sum("_n").alias("packets"), F.sum(F.col("_n") - 1).alias("retransmissions")
    )


def mark_latency(df: DataFrame, key: Sequence[str] = ("cid",)) -> DataFrame:
    """`broker_latency_ms` on responses whose request was the previous packet of the key.

    The last request of an id wins and is answered once, which is the same as: the
    packet before the response, among those of its id, is a request. `key` may add
    the client endpoint so that ids of different connections do not mix.
    """
    usable = (F.col("payload_len") > HEADER_BYTES) & F.col("cid").isNotNull()
    names = [f"_k{i}" for i in range(len(key))]
    keyed = df.withColumns({n: F.when(usable, F.col(k)) for n, k in zip(names, key)})
    keyed = keyed.withColumn("_usable", usable)
    o = Ordered(keyed, [*names, "_usable"], ["ts", "packet_id"]).lag(["ts", "to_broker"])
    answered = F.col("_usable") & ~F.col("to_broker") & F.col("_prev1.to_broker")
    ms = (micros("ts") - micros("_prev1.ts")) / 1e3
    return (
        o.result()
        .withColumn("broker_latency_ms", F.when(answered, ms))
        .drop(*names, "_usable", "_prev1")
    )


def match_requests(df: DataFrame, key: Sequence[str] = ("cid",)) -> DataFrame:
    """Answered requests: cid, response time, latency in ms."""
    usable = df.where((F.col("payload_len") > HEADER_BYTES) & F.col("cid").isNotNull())
    return (
        mark_latency(usable, key)
        .where("broker_latency_ms is not null")
        .select("packet_id", "cid", "ts", "broker_latency_ms")
    )


def mark_rtt(df: DataFrame) -> DataFrame:
    """`rtt_ms` on SYN-ACK packets whose client endpoint last sent a SYN."""
    bits = F.col("tcp_flags").bitwiseAND(SYN_ACK)
    keyed = df.withColumn("_hs", F.when(bits == SYN, "syn").when(bits == SYN_ACK, "ack"))
    keyed = keyed.withColumn("_open", F.col("_hs").isNotNull())
    o = Ordered(keyed, ["client_ip", "client_port", "_open"], ["ts", "packet_id"]).lag(["ts", "_hs"])
    opened = (F.col("_hs") == "ack") & (F.col("_prev1._hs") == "syn")
    ms = (micros("ts") - micros("_prev1.ts")) / 1e3
    return o.result().withColumn("rtt_ms", F.when(opened, ms)).drop("_hs", "_open", "_prev1")


def rtt(df: DataFrame) -> DataFrame:
    """Handshake round trips: endpoint, time, ms."""
    syn = df.where(F.col("tcp_flags").bitwiseAND(SYN) != 0)
    return (
        mark_rtt(syn)
        .where("rtt_ms is not null")
        .select("packet_id", "client_ip", "client_port", "ts", "rtt_ms")
    )


def jitter(df: DataFrame, by: Sequence[str] = ("src_ip",), max_gap_ms: float = 1000) -> DataFrame:
    """Mean absolute change between consecutive inter-arrival times of broker packets.

    Gaps of `max_gap_ms` and more are idle time; the change is taken between the
    gaps that are kept.
    """
    gap = (micros("ts") - micros("_prev1.ts")) / 1e3
    o = (
        Ordered(df.where(~F.col("to_broker")).select(*by, "ts", "packet_id"), by, ["ts", "packet_id"])
        .lag(["ts"])
        .then(lambda r: r.withColumn("_gap", gap).where(F.col("_gap") < max_gap_ms).drop("_prev1"))
        .lag(["_gap"])
    )
    change = F.abs(F.col("_gap") - F.col("_prev1._gap"))
    return (
        o.result()
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("gaps"),
            F.avg("_gap").alias("mean_gap_ms"),
            F.coalesce(F.avg(change), F.lit(0.0)).alias("jitter_ms"),
        )
    )


def packet_table(df: DataFrame) -> DataFrame:
    """Every broker packet with round trip, broker latency and retransmission mark."""
    marked = mark_retransmissions(df)
    full = mark_rtt(mark_latency(marked))
    return full.select(
        "packet_id",
        "ts",
        "src_ip",
        "dst_ip",
        "tcp_flags",
        "window_size",
        "payload_len",
        "rtt_ms",
        "broker_latency_ms",
        "is_retransmission",
        F.lit(0).alias("actual_msg_count"),
    )


def network_report(df: DataFrame, key: Sequence[str] = ("cid",)) -> DataFrame:
    """One row: packet counts, retransmissions, jitter, broker latency mean and p95."""
    again = retransmissions(df, []).select(F.coalesce("retransmissions", F.lit(0)))
    shake = jitter(df.withColumn("_one", F.lit(0)), ["_one"]).select("jitter_ms")
    matched = match_requests(df, key)
    mean = matched.agg(F.avg("broker_latency_ms").alias("m"))
    p95 = exact_quantiles(matched, [], "broker_latency_ms", [0.95]).select(F.col("q")[0])
    return tcp_health(df).select(
        "*",
        F.coalesce(again.scalar(), F.lit(0)).alias("retransmissions"),
        F.coalesce(shake.scalar(), F.lit(0.0)).alias("jitter_ms"),
        mean.scalar().alias("latency_avg_ms"),
        p95.scalar().alias("latency_p95_ms"),
    )


