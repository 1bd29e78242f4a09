"""Packet captures as rows (SRC9, SRC13).

Captures are written in rotated files, each read by one task; packets leave the
task in batches, so a task holds one file and one batch.
"""

from __future__ import annotations

import socket
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKET_SCHEMA = (
    "file string, packet_no bigint, ts timestamp, src_ip string, dst_ip string, sport int, dport int, "
    "seq bigint, tcp_flags int, window_size int, payload_len int, head binary"
)
HEAD_BYTES = 12
BATCH = 20_000
# File magic with its byte order and ticks per second; header bytes before IP per link type.
MAGICS = {
    b"\xd4\xc3\xb2\xa1": ("<", 1_000_000),
    b"\xa1\xb2\xc3\xd4": (">", 1_000_000),
    b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000),
    b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000),
}
LINK_HEADERS = {1: 14, 101: 0, 113: 16, 276: 20}
IPV4, TCP = 4, 6


def read_captures(spark: SparkSession, path: str, end=None, glob: str = "*.pcap") -> DataFrame:
    """Capture files (path, content); files whose name says they start after `end` are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    if end is not None:
        stamp = F.regexp_extract("_metadata.file_name", r"(\d{8}_\d{6})", 1)
        started = F.try_to_timestamp(stamp, F.lit("yyyyMMdd_HHmmss"))
        files = files.where(started.isNull() | (started <= F.lit(end)))
    return files.select("path", "content")


def packets_of(content: bytes) -> Iterator[tuple]:
    """(µs, src, dst, sport, dport, seq, flags, window, payload length, payload head) of TCP packets."""
    if content[:4] not in MAGICS:
        raise ValueError("not a packet capture")
    order, ticks = MAGICS[content[:4]]
    link = struct.unpack_from(order + "I", content, 20)[0]
    if link not in LINK_HEADERS:
        raise ValueError(f"unknown link type: {link}")
    at = 24
    while at + 16 <= len(content):
        sec, frac, kept, _ = struct.unpack_from(order + "IIII", content, at)
        at += 16
        ip, stop = at + LINK_HEADERS[link], at + kept
        at = stop
        if ip + 20 > stop or content[ip] >> 4 != IPV4 or content[ip + 9] != TCP:
            continue
        size = struct.unpack_from(">H", content, ip + 2)[0]
        tcp = ip + (content[ip] & 15) * 4
        if tcp + 20 > stop:
            continue
        sport, dport, seq, _, offset, flags, window = struct.unpack_from(">HHIIBBH", content, tcp)
        body = tcp + (offset >> 4) * 4
        length = max(ip + size - body, 0) if size else max(stop - body, 0)
        yield (
            sec * 1_000_000 + frac * 1_000_000 // ticks,
            socket.inet_ntoa(content[ip + 12 : ip + 16]),
            socket.inet_ntoa(content[ip + 16 : ip + 20]),
            sport,
            dport,
            seq,
            flags,
            window,
            length,
            content[body : min(body + HEAD_BYTES, stop, body + length)],
        )


def _frame(file: str, first: int, rows: list[tuple]) -> pd.DataFrame:
    cols = ["ts", "src_ip", "dst_ip", "sport", "dport", "seq", "tcp_flags", "window_size", "payload_len", "head"]
    out = pd.DataFrame(rows, columns=cols)
    out["ts"] = pd.to_datetime(out["ts"], unit="us", utc=True)
    out.insert(0, "packet_no", range(first, first + len(rows)))
    out.insert(0, "file", file)
    return out


def decode_captures(files: DataFrame) -> DataFrame:
    """One row per TCP packet of the capture files."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows, done = [], 0
                for packet in packets_of(bytes(content)):
                    rows.append(packet)
                    if len(rows) == BATCH:
                        yield _frame(path, done, rows)
                        done, rows = done + len(rows), []
                if rows:
                    yield _frame(path, done, rows)

    return files.select("path", "content").mapInPandas(decode, PACKET_SCHEMA)


def with_cid(packets: DataFrame, broker_port: int) -> DataFrame:
    """Correlation id: bytes 8-11 of a request's payload, 4-7 of a response's.

    `packet_id` orders packets captured at the same time.
    """
    request = F.col("dport") == broker_port
    four = F.expr(f"if(dport = {broker_port}, substring(head, 9, 4), substring(head, 5, 4))")
    cid = F.conv(F.hex(four), 16, 10).cast("long")
    known = (F.col("payload_len") > HEAD_BYTES) & (request | (F.col("sport") == broker_port))
    return packets.withColumn("cid", F.when(known, cid)).withColumn(
        "packet_id", F.struct("file", "packet_no")
    )
