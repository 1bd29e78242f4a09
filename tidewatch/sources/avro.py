"""Framed Avro records: one magic byte, a four-byte schema id, then the body (PRJ2, PRJ3, SNK10).

With the spark-avro package on the class path pass `native=True`. Otherwise the
flat records used here are decoded batch by batch in an Arrow function.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.schemas import avro_to_struct, widen_floats

FRAME_BYTES = 5
_FIXED = {"float": (4, "<f4", pa.float32()), "double": (8, "<f8", pa.float64())}


def _fields(schema_json: str) -> list[tuple[str, str]]:
    return [(f["name"], f["type"]) for f in json.loads(schema_json)["fields"]]


def _varints(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zig-zag numbers at positions `at`, and the positions after them."""
    raw = np.zeros(len(at), dtype=np.uint64)
    more = np.ones(len(at), dtype=bool)
    for shift in range(0, 70, 7):
        byte = data[np.minimum(at, len(data) - 1)].astype(np.uint64)
        raw |= np.where(more, (byte & np.uint64(0x7F)) << np.uint64(min(shift, 63)), np.uint64(0))
        at = at + more
        more = more & (byte >= 0x80)
        if not more.any():
            break
    return (raw >> np.uint64(1)).astype(np.int64) ^ -(raw & np.uint64(1)).astype(np.int64), at


def decode_batch(bodies: pa.Array, fields: Sequence[tuple[str, str]]) -> tuple[pa.Array, np.ndarray]:
    """Struct array of the decoded bodies and a mask of the rows that were complete."""
    bodies = bodies.cast(pa.large_binary())
    n = len(bodies)
    offsets = np.frombuffer(bodies.buffers()[1], dtype=np.int64)[bodies.offset : bodies.offset + n + 1]
    buffer = bodies.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(1, np.uint8)
    at, end = offsets[:-1].copy(), offsets[1:]
    ok = ~np.asarray(bodies.is_null())
    columns = []
    for _, kind in fields:
        if kind in _FIXED:
            width, layout, arrow = _FIXED[kind]
            cells = data[np.minimum(at[:, None] + np.arange(width), len(data) - 1)]
            columns.append((np.ascontiguousarray(cells).view(layout).ravel(), arrow))
            at = at + width
        elif kind in ("int", "long"):
            numbers, at = _varints(data, at)
            if kind == "int":
                columns.append((numbers.astype(np.int32), pa.int32()))
            else:
                columns.append((numbers, pa.int64()))
        else:
            length, at = _varints(data, at)
            fits = ok & (length >= 0) & (at + length <= end)
            text = [
                data[a : a + size].tobytes().decode() if good else None
                for a, size, good in zip(at, length, fits)
            ]
            ok, at = fits, np.where(fits, at + length, end)
            columns.append((text, pa.string()))
        ok = ok & (at <= end)
        at = np.minimum(at, end)
    arrays = [pa.array(values, type=kind) for values, kind in columns]
    names = [name for name, _ in fields]
    return pa.StructArray.from_arrays(arrays, names=names, mask=pa.array(~ok)), ok


def decode_framed(
    df: DataFrame,
    value: str,
    schema_json: str,
    out: str = "parsed_value",
    *,
    native: bool = False,
    mode: str = "FAILFAST",
    widen: bool = False,
) -> DataFrame:
    """Adds `out`, the record struct behind the frame of the binary column `value`.

    A body that ends too early is an error, or null with mode PERMISSIVE.
    """
    body = F.expr(f"substring({value}, {FRAME_BYTES + 1}, length({value}) - {FRAME_BYTES})")
    if native:
        from pyspark.sql.avro.functions import from_avro

        return df.withColumn(out, from_avro(body, schema_json, {"mode": mode}))
    fields = _fields(schema_json)

    @F.arrow_udf(avro_to_struct(schema_json))
    def decode(bodies: pa.Array) -> pa.Array:
        rows, ok = decode_batch(bodies, fields)
        if mode == "FAILFAST" and not (ok | np.asarray(bodies.is_null())).all():
            raise ValueError("record body ends before its last field")
        return rows

    parsed = decode(body)
    if widen:
        parsed = parsed.cast(avro_to_struct(widen_floats(schema_json)))
    return df.withColumn(out, parsed)


def _zigzag(number: int) -> bytes:
    number = (number << 1) ^ (number >> 63)
    out = bytearray()
    while number > 0x7F:
        out.append((number & 0x7F) | 0x80)
        number >>= 7
    out.append(number)
    return bytes(out)


def encode_row(values: Sequence, fields: Sequence[tuple[str, str]], schema_id: int) -> bytes:
    """Frame and body of one flat record."""
    parts = [struct.pack(">bI", 0, schema_id)]
    for value, (name, kind) in zip(values, fields):
        if value is None:
            raise ValueError(f"field {name} is null")
        if kind == "float":
            parts.append(struct.pack("<f", value))
        elif kind == "double":
            parts.append(struct.pack("<d", value))
        elif kind in ("int", "long"):
            parts.append(_zigzag(value))
        else:
            text = value.encode()
            parts.append(_zigzag(len(text)) + text)
    return b"".join(parts)


def encode_framed(record: Column | str, schema_json: str, schema_id: int, *, native: bool = False) -> Column:
    """Binary column of framed records from a struct column with the schema's fields."""
    c = F.col(record) if isinstance(record, str) else record
    fields = _fields(schema_json)
    if native:
        from pyspark.sql.avro.functions import to_avro

        frame = F.concat(F.unhex(F.lit("00")), F.unhex(F.lit(f"{schema_id:08X}")))
        return F.concat(frame, to_avro(c, schema_json))

    @F.arrow_udf("binary")
    def encode(rows: pa.Array) -> pa.Array:
        columns = [rows.field(name).to_pylist() for name, _ in fields]
        return pa.array([encode_row(v, fields, schema_id) for v in zip(*columns)], type=pa.binary())

    return encode(c)


def header_value(headers: Column | str, key: str, kind: str = "string") -> Column:
    """Value of a record header; null if absent or not readable, the last one if repeated."""
    c = F.col(headers) if isinstance(headers, str) else headers
    hits = F.filter(c, lambda h: h["key"] == key)
    text = F.try_element_at(hits, F.lit(-1))["value"].cast("string")
    return text if kind == "string" else text.try_cast(kind)


def decode_json(df: DataFrame, value: str, schema, keep: Sequence[str] = ()) -> DataFrame:
    """Fields of a JSON column as columns."""
    parsed = F.from_json(F.col(value).cast("string"), schema)
    return df.select(*keep, parsed.alias("_data")).select(*keep, "_data.*")


def flatten(df: DataFrame, col: str) -> DataFrame:
    """A struct column replaced by its fields."""
    return df.select(*[c for c in df.columns if c != col], f"{col}.*")


def to_topic(
    df: DataFrame,
    key: Column | str,
    record: Column | str,
    schema_json: str,
    schema_id: int,
    topic: str,
    headers: dict[str, Column] | None = None,
    *,
    native: bool = False,
) -> DataFrame:
    """Rows in the shape a topic sink takes: key, value, headers, topic."""
    pairs = [
        F.struct(F.lit(k).alias("key"), v.cast("string").cast("binary").alias("value"))
        for k, v in (headers or {}).items()
    ]
    empty = F.array().cast("array<struct<key:string,value:binary>>")
    return df.select(
        (F.col(key) if isinstance(key, str) else key).cast("string").cast("binary").alias("key"),
        encode_framed(record, schema_json, schema_id, native=native).alias("value"),
        (F.array(*pairs) if pairs else empty).alias("headers"),
        F.lit(topic).alias("topic"),
    )
