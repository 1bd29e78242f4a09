"""Tables and files to read (SRC)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.joins import attach

# Options of the deployed topic reader.
TOPIC_OPTIONS = {
    "startingOffsets": "earliest",
    "failOnDataLoss": "false",
    "minPartitions": "4",
    "maxOffsetsPerTrigger": "400000",
    "kafka.fetch.max.wait.ms": "20",
    "kafka.fetch.min.bytes": "1",
    "kafka.max.poll.records": "50000",
    "includeHeaders": "true",
}
# Columns of the host sampler's CSV.
VMSTAT_COLUMNS = ["r", "b", "swpd", "free", "buff", "cache", "si", "so", "bi", "bo", "in", "cs", "us", "sy", "id", "wa", "st"]
RANGE_SCHEMA = "array<struct<metric: map<string, string>, values: array<array<string>>>>"


def read_stream(
    spark: SparkSession,
    fmt: str,
    where: str,
    schema=None,
    *,
    servers: str | None = None,
    max_per_trigger: int | None = None,
    min_partitions: int | None = None,
    starting: str | int | None = None,
    glob: str | None = None,
) -> DataFrame:
    """Unbounded source: a topic (`kafka`), a table's change feed (`delta`), or a folder of files."""
    reader = spark.readStream.format(fmt)
    if fmt == "kafka":
        reader = reader.options(**TOPIC_OPTIONS).option("subscribe", where)
        reader = reader.option("kafka.bootstrap.servers", servers)
        if max_per_trigger:
            reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
        if min_partitions:
            reader = reader.option("minPartitions", min_partitions)
        if starting is not None:
            reader = reader.option("startingOffsets", starting)
        return reader.load()
    if fmt == "delta":
        start = 0 if starting is None else starting
        return reader.option("readChangeFeed", "true").option("startingVersion", start).load(where)
    if max_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.schema(schema).load(where)


def read_table(
    spark: SparkSession, path: str | Sequence[str], fmt: str = "parquet", columns: Sequence[str] | None = None
) -> DataFrame:
    """Batch scan by path, glob or several paths; a column list prunes the scan."""
    df = spark.read.format(fmt).load(path if isinstance(path, str) else list(path))
    return df if columns is None else df.select(*columns)


def read_concat(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """Files of equal columns below each other, matched by name."""
    return reduce(lambda a, b: a.unionByName(b), [read_table(spark, p, fmt) for p in paths])


def as_view(df: DataFrame, name: str) -> DataFrame:
    """Register for SQL and return the view."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def read_metric(spark: SparkSession, root: str, metric: str) -> DataFrame:
    """One metric of a table partitioned by metric; `*` in the name matches any text."""
    df = spark.read.parquet(root)
    if "*" not in metric:
        return df.where(F.col("metric") == metric)
    return df.where(F.col("metric").like(metric.replace("_", r"\_").replace("*", "%")))


def first_metric(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """The first metric by name that matches the pattern."""
    hits = read_metric(spark, root, pattern)
    return hits.where(F.col("metric") == hits.agg(F.min("metric").alias("m")).scalar())


def read_loadtest_csv(spark: SparkSession, path: str, spread: int | None = None) -> DataFrame:
    """Load-test samples; compressed files are one task each, so `spread` shuffles rows after reading."""
    df = spark.read.csv(path, header=True)
    typed = df.withColumns(
        {
            "timestamp": F.col("timestamp").try_cast("double").cast("long"),
            "metric_value": F.col("metric_value").try_cast("double"),
        }
    )
    return typed.repartition(spread) if spread else typed


def read_vmstat(spark: SparkSession, path: str) -> DataFrame:
    """Host samples with the machine's total memory from the comment line of each file."""
    schema = ", ".join(f"`{c}` int" for c in VMSTAT_COLUMNS) + ", timestamp string"
    rows = spark.read.csv(
        path,
        schema=schema,
        header=True,
        comment="#",
        ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True,
    ).select("*", F.col("_metadata.file_path").alias("file"))
    total = F.regexp_extract("value", r"TOTAL_MEM_KB:\s*(\d+)", 1)
    memory = (
        spark.read.text(path)
        .where(F.col("value").startswith("#"))
        .select(F.col("_metadata.file_path").alias("file"), total.try_cast("long").alias("total_mem_kb"))
        .groupBy("file")
        .agg(F.max("total_mem_kb").alias("total_mem_kb"))
    )
    return rows.join(memory, "file", "left").withColumn("timestamp", F.to_timestamp("timestamp"))


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of event logs (app, value) below a folder; logs split at line ends.

    `app` is the application's id, and its attempt, from the log's own start event, so logs
    of equal names are told apart and the files of a log that was rolled belong together:
    they lie in one folder (`eventlog_v2_...`) of which only the first file has the start
    event. A log without one goes by its path. The start events, one per log, are looked up
    by the log's path from the file metadata, whatever file of it a line is in.
    """
    file = F.col("_metadata.file_path")
    rolled = F.regexp_extract(file, r"^(.*/eventlog_v2_[^/]+)/[^/]*$", 1)
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    lines = lines.select(F.when(rolled != "", rolled).otherwise(file).alias("log"), "value")
    start = "SparkListenerApplicationStart"
    event = F.from_json("value", "`Event` string, `App ID` string, `App Attempt ID` string")
    starts = lines.where(F.col("value").contains(start)).select("log", F.inline(F.array(event))).where(F.col("Event") == start)
    apps = starts.groupBy("log").agg(F.max(F.concat_ws("_", "App ID", "App Attempt ID")).alias("_app"))
    named = attach(lines, apps, ["log"], few_groups=True)
    return named.select(F.coalesce("_app", "log").alias("app"), "value")


def flatten_range_json(df: DataFrame, value: str = "value", labels: Sequence[str] | None = None) -> DataFrame:
    """Saved metric range responses as samples: metric, timestamp, labels, value.

    Takes a JSON array of series, or one series per line.
    """
    many = F.from_json(value, RANGE_SCHEMA)
    text = F.when(F.trim(value).startswith("["), F.col(value)).otherwise(F.concat(F.lit("["), F.col(value), F.lit("]")))
    series = df.withColumn(value, text).select(F.explode(many).alias("s"))
    samples = series.select("s.metric", F.explode("s.values").alias("v"))
    name = F.col("metric")["__name__"]
    at = F.timestamp_micros(F.round(F.col("v")[0].try_cast("double") * 1e6).cast("long"))
    kept = (
        [F.col("metric")[x].alias(x) for x in labels]
        if labels is not None
        else [F.map_filter("metric", lambda k, _: k != "__name__").alias("labels")]
    )
    return samples.select(
        name.alias("metric"), at.alias("timestamp"), *kept, F.col("v")[1].try_cast("double").alias("value")
    )


def measurements(df: DataFrame) -> DataFrame:
    return df.select("_measurement").distinct()


def pivot_fields(
    df: DataFrame,
    time: str,
    tags: Sequence[str],
    field: str,
    value: str,
    fields: Sequence[str],
    *,
    start=None,
    end=None,
) -> DataFrame:
    """Field rows of one time range as columns keyed by time and tags."""
    if start is not None:
        df = df.where(F.col(time) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(time) < F.lit(end))
    return df.groupBy(time, *tags).pivot(field, list(fields)).agg(F.first(value, ignorenulls=True))


def concat_capped(frames: Sequence[DataFrame], order: Sequence[str], max_rows: int | None = None) -> DataFrame:
    """Subsets below each other in order, optionally only the first `max_rows` rows."""
    parts = [df.withColumn("_part", F.lit(i)) for i, df in enumerate(frames)]
    whole = reduce(lambda a, b: a.unionByName(b), parts)
    if max_rows:
        whole = whole.orderBy("_part", *order).limit(max_rows)
    return whole.drop("_part")
