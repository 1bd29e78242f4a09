"""Topic → raw table → processed table (STR)."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidewatch.functions.timeutil import stamp_landing
from tidewatch.sources.avro import decode_framed, header_value
from tidewatch.sources.sinks import write_stream
from tidewatch.sources.tables import read_stream

PROGRESS_SCHEMA = (
    "name string, batch_id bigint, started string, input_rows bigint, "
    "input_rate double, processing_rate double, latency_ms bigint"
)


def ingest(records: DataFrame, schema_json: str, *, native: bool = False) -> DataFrame:
    """Topic records as raw table rows; the same for a stream and for a batch.

    Stateless and without shuffle: topic, broker time, landing time, send time from
    the header, decoded record.
    """
    landed = stamp_landing(records).withColumn("sent_at_ts", header_value("headers", "sent_at", "long"))
    return decode_framed(landed, "value", schema_json, native=native).select(
        "topic", "timestamp", "landing_timestamp", "sent_at_ts", "parsed_value"
    )


def run_ingest(
    spark: SparkSession,
    source: DataFrame,
    schema_json: str,
    path: str,
    checkpoint: str,
    *,
    fmt: str = "delta",
    topic: str = "robot_data-avro",
    trigger: str = "5 seconds",
    native: bool = False,
    explain: bool = False,
) -> StreamingQuery:
    """Start the append stream into the raw table; exactly once through its checkpoint."""
    rows = ingest(source, schema_json, native=native)
    query = write_stream(rows, fmt, path, checkpoint, name=f"raw_{topic}", trigger=trigger)
    if explain:
        query.explain(True)
    return query


def propagate(
    spark: SparkSession,
    raw_path: str,
    path: str,
    checkpoint: str,
    *,
    fmt: str = "delta",
    schema=None,
    trigger: str = "5 seconds",
    starting: str | int | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Start the stream of the raw table's changes into the processed table."""
    changes = read_stream(spark, fmt, raw_path, schema, starting=starting)
    return write_stream(changes, fmt, path, checkpoint, name=name, trigger=trigger, merge_schema=True)


def batch_writer(path: str):
    """Writes a micro-batch to a folder of its own, `batch=<id>`, in place of what is there.

    A batch that Spark replays after a failure replaces itself, so no row comes twice; columns
    that a later batch adds stand in its folder and are null in the earlier ones.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return save


def propagate_evolving(changes: DataFrame, path: str, checkpoint: str, *, trigger: str = "5 seconds") -> StreamingQuery:
    """Start the second hop into a table whose columns may grow, exactly once per batch."""
    writer = changes.writeStream.foreachBatch(batch_writer(path)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if trigger == "availableNow" else writer.trigger(processingTime=trigger)
    return writer.start()


def read_evolving(spark: SparkSession, path: str) -> DataFrame:
    """The table with all columns that any batch has, and the batch of each row."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def change_view(changes: DataFrame) -> DataFrame:
    """Broker time and landing time of changed rows under their report names."""
    return changes.select("timestamp", "landing_timestamp").withColumnsRenamed(
        {"timestamp": "kafka_timestamp", "landing_timestamp": "spark_timestamp"}
    )


def watch(query: StreamingQuery, every: float = 5.0, report=print) -> None:
    """Report the last progress until the stream stops."""
    while query.isActive:
        report(query.lastProgress)
        time.sleep(every)
    report(query.lastProgress)


def progress_rows(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """Rates and latency of the micro-batches Spark still remembers, one row each."""
    rows = [
        (
            p["name"],
            p["batchId"],
            p["timestamp"],
            p["numInputRows"],
            float(p.get("inputRowsPerSecond") or 0.0),
            float(p.get("processedRowsPerSecond") or 0.0),
            int((p.get("durationMs") or {}).get("triggerExecution", 0)),
        )
        for p in query.recentProgress
    ]
    return spark.createDataFrame(rows, PROGRESS_SCHEMA)


def progress_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("name").agg(
        F.count(F.lit(1)).alias("batches"),
        F.sum("input_rows").alias("input_rows"),
        F.avg("processing_rate").alias("processing_rate"),
        F.max("latency_ms").alias("max_latency_ms"),
    )
