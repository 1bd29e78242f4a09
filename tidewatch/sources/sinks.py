"""Tables and files to write (SNK)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidewatch.sources.avro import flatten

# Options of the deployed table sink.
TABLE_OPTIONS = {
    "delta.enableChangeDataFeed": "false",
    "delta.autoOptimize.optimizeWrite": "true",
    "delta.autoOptimize.autoCompact": "true",
    "delta.logRetentionDuration": "interval 1 day",
    "delta.checkpointInterval": "10",
}
EXPORT_ROWS = 36_000


def write_stream(
    df: DataFrame,
    fmt: str,
    path: str | None,
    checkpoint: str,
    *,
    name: str | None = None,
    trigger: str = "5 seconds",
    merge_schema: bool = False,
    mode: str = "append",
    options: Mapping[str, str] | None = None,
) -> StreamingQuery:
    """Start a checkpointed stream into a table; trigger `availableNow` drains the source and stops."""
    writer = df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
    if fmt == "delta":
        writer = writer.options(**TABLE_OPTIONS).option("mergeSchema", str(merge_schema).lower())
    if options:
        writer = writer.options(**options)
    if name:
        writer = writer.queryName(name)
    if trigger == "availableNow":
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=trigger)
    return writer.start(path) if path else writer.start()


def export_flat(df: DataFrame, struct_col: str, path: str) -> None:
    """Nested table as a flat one, in as many files as Spark has partitions."""
    flatten(df, struct_col).write.mode("overwrite").parquet(path)


def write_metrics(df: DataFrame, root: str) -> None:
    """Samples in one folder per metric, so a reader prunes to the metric it wants."""
    df.write.mode("overwrite").partitionBy("metric").parquet(root)


def write_packets(df: DataFrame, path: str) -> None:
    """Packets by time: ranges of time per file, sorted inside, snappy."""
    by_time = df.repartitionByRange("ts").sortWithinPartitions("ts")
    by_time.write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_tables(tables: Mapping[str, DataFrame], root: str) -> None:
    """Several named tables below one folder, for example jobs, stages and tasks."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def write_acks(df: DataFrame, path: str) -> None:
    """Acknowledgement records with their declared types."""
    typed = df.select(
        F.col("source_timestamp").cast("long"), F.col("robot_id").cast("int"), F.col("ack_latency").cast("double")
    )
    typed.write.mode("append").parquet(path)


def export_rows(df: DataFrame, order: Sequence[str], path: str, max_rows: int = EXPORT_ROWS) -> None:
    """The first rows of a dataset in order."""
    df.orderBy(*order).limit(max_rows).write.mode("overwrite").parquet(path)


def create_empty(
    spark: SparkSession, schema, path: str, fmt: str = "parquet", options: Mapping[str, str] | None = None
) -> None:
    """Empty table with a declared schema and table properties."""
    empty = spark.createDataFrame([], schema)
    empty.write.format(fmt).mode("overwrite").options(**(options or {})).save(path)


def describe_table(df: DataFrame) -> DataFrame:
    """Column names, types and whether they may be null."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string, nullable boolean")


def table_detail(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Number of files, bytes and rows of a table, files without rows included.

    Files and bytes come from a listing whose contents are not read; rows are counted without
    any column, which for Parquet reads the footers alone.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{fmt}").load(path)
    rows = spark.read.format(fmt).load(path).agg(F.count(F.lit(1)).alias("n"))
    return listing.select("length").agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), rows.scalar().alias("rows")
    )


def publish(df: DataFrame, servers: str) -> None:
    """Write rows made by `to_topic` to their topics."""
    df.write.format("kafka").option("kafka.bootstrap.servers", servers).save()
