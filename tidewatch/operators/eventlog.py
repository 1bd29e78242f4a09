"""Jobs, stages and tasks from Spark event logs (EVL)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.timeutil import as_column, to_zone
from tidewatch.operators.joins import kept
from tidewatch.operators.latency import describe, describe_columns

# The parts of each event that are read, under the names Spark writes.
EVENT_SCHEMAS = {
    "SparkListenerJobStart": """
        `Event` string, `Job ID` bigint, `Submission Time` bigint,
        `Stage Infos` array<struct<`Stage ID`: bigint>>
    """,
    "SparkListenerJobEnd": """
        `Event` string, `Job ID` bigint, `Completion Time` bigint, `Job Result` struct<`Result`: string>
    """,
    "SparkListenerStageCompleted": """
        `Event` string, `Stage Info` struct<
            `Stage ID`: bigint, `Stage Attempt ID`: bigint, `Stage Name`: string,
            `Submission Time`: bigint, `Completion Time`: bigint, `Number of Tasks`: bigint,
            `Accumulables`: array<struct<`Name`: string, `Value`: string>>>
    """,
    "SparkListenerTaskEnd": """
        `Event` string, `Stage ID` bigint, `Stage Attempt ID` bigint,
        `Task Info` struct<
            `Task ID`: bigint, `Executor ID`: string, `Host`: string,
            `Launch Time`: bigint, `Finish Time`: bigint, `Failed`: boolean, `Successful`: boolean>,
        `Task Metrics` struct<
            `Memory Bytes Spilled`: bigint, `Disk Bytes Spilled`: bigint,
            `Input Metrics`: struct<`Bytes Read`: bigint>,
            `Shuffle Read Metrics`: struct<`Remote Bytes Read`: bigint>,
            `Shuffle Write Metrics`: struct<`Shuffle Bytes Written`: bigint>>
    """,
}

# Output column and the accumulable it comes from.
STAGE_ACCUMULABLES = {
    "ShuffleReadBytes": "internal.metrics.shuffle.read.remoteBytesRead",
    "ShuffleWriteBytes": "internal.metrics.shuffle.write.bytesWritten",
    "InputRecords": "internal.metrics.input.recordsRead",
    "OutputRecords": "internal.metrics.output.recordsWritten",
    "GCTimeMs": "internal.metrics.jvmGCTime",
    "DurationMs": "duration",
}

# Job type by job id modulo 3.
JOB_TYPES = {0: "Planning", 1: "Kafka Fetch", 2: "Transformations"}


_ROW = [("Kind", "string"), ("ID", "bigint"), ("JobID", "bigint"), ("Result", "string")]
_ATTEMPT = [
    ("Attempt", "bigint"), ("Name", "string"), ("SubmissionTime", "bigint"), ("CompletionTime", "bigint"), ("NumTasks", "bigint"),
    ("Accumulables", "array<struct<Name: string, Value: string>>"),
]
_HISTORY = """struct<
    `Event`: string, `Job ID`: bigint, `Submission Time`: bigint, `Completion Time`: bigint,
    `Stage Infos`: array<struct<`Stage ID`: bigint>>, `Job Result`: struct<`Result`: string>,
    `Stage Info`: struct<
        `Stage ID`: bigint, `Stage Attempt ID`: bigint, `Stage Name`: string,
        `Submission Time`: bigint, `Completion Time`: bigint, `Number of Tasks`: bigint,
        `Accumulables`: array<struct<`Name`: string, `Value`: string>>>>"""


def _naming(names: Sequence[str]) -> Column:
    """Whether a line contains one of the names. The line stands in an array so that a line
    which is itself computed is computed once, not once per name."""
    return F.exists(F.array("value"), lambda line: reduce(or_, [line.contains(n) for n in names]))


def kept_events(lines: DataFrame, names: Sequence[str]) -> DataFrame:
    """The parsed events of several kinds, written once; `events`, `jobs`, `stages` and
    `stage_to_job` take them in place of lines, which are then read and parsed once for all."""
    fields = {f.name: f for n in names for f in T.StructType.fromDDL(EVENT_SCHEMAS[n]).fields}
    event = F.from_json("value", T.StructType([*fields.values()]))
    rows = lines.where(_naming(names)).select("app", F.inline(F.array(event)))
    return kept(rows.where(F.col("Event").isin(list(names))), "events")


def events(lines: DataFrame, name: str) -> DataFrame:
    """Parsed events of one kind from log lines (app, value), or from `kept_events`.

    Lines that do not even contain the name are dropped before the JSON is parsed;
    lines that are not JSON drop out, see `bad_lines`. `inline` keeps Spark from
    parsing a line again for the filter.
    """
    if "value" not in lines.columns:
        fields = T.StructType.fromDDL(EVENT_SCHEMAS[name]).names
        return lines.where(F.col("Event") == name).select("app", *[F.col(f"`{n}`") for n in fields])
    event = F.from_json("value", EVENT_SCHEMAS[name])
    rows = lines.where(F.col("value").contains(name)).select("app", F.inline(F.array(event)))
    return rows.where(F.col("Event") == name)


def bad_lines(lines: DataFrame) -> DataFrame:
    """Lines that are neither blank nor JSON."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    event = F.from_json("value", "`Event` string, `_bad` string", options)
    rows = lines.where(F.trim("value") != "").select("app", "value", F.inline(F.array(event)))
    return rows.where("_bad is not null").select("app", F.col("value").alias("line"))


def _seconds(end: str, start: str) -> Column:
    return ((F.col(end) - F.col(start)) / 1000).alias("DurationSec")


def jobs(lines: DataFrame) -> DataFrame:
    """One row per started job; completion and result are null while it has not ended."""
    started = events(lines, "SparkListenerJobStart").select(
        "app", F.col("Job ID").alias("JobID"), F.col("Submission Time").alias("SubmissionTime")
    )
    ended = events(lines, "SparkListenerJobEnd").select(
        "app",
        F.col("Job ID").alias("JobID"),
        F.col("Completion Time").alias("CompletionTime"),
        F.col("Job Result.Result").alias("JobResult"),
    )
    return started.join(ended, ["app", "JobID"], "left").select(
        "*", _seconds("CompletionTime", "SubmissionTime")
    )


def stage_to_job(lines: DataFrame) -> DataFrame:
    """Job of each stage; a stage listed by several jobs belongs to the last one."""
    return (
        events(lines, "SparkListenerJobStart")
        .select("app", F.col("Job ID").alias("JobID"), F.explode("`Stage Infos`.`Stage ID`").alias("StageID"))
        .groupBy("app", "StageID")
        .agg(F.max("JobID").alias("JobID"))
    )


def _accumulable(name: str) -> Column:
    hits = F.filter("`Stage Info`.`Accumulables`", lambda a: a["Name"] == name)
    return F.coalesce(F.get(hits, F.lit(0))["Value"].try_cast("long"), F.lit(0))


def stages(lines: DataFrame) -> DataFrame:
    info = F.col("Stage Info")
    done = events(lines, "SparkListenerStageCompleted").select(
        "app",
        info["Stage ID"].alias("StageID"),
        info["Stage Attempt ID"].alias("StageAttemptID"),
        F.coalesce(info["Stage Name"], F.lit("unknown")).alias("StageName"),
        info["Submission Time"].alias("SubmissionTime"),
        info["Completion Time"].alias("CompletionTime"),
        F.coalesce(info["Number of Tasks"], F.lit(0)).alias("NumTasks"),
        *[_accumulable(acc).alias(col) for col, acc in STAGE_ACCUMULABLES.items()],
    )
    return done.join(stage_to_job(lines), ["app", "StageID"], "left").select(
        "*", _seconds("CompletionTime", "SubmissionTime")
    )


def tasks(lines: DataFrame) -> DataFrame:
    info, metrics = F.col("Task Info"), F.col("Task Metrics")
    took = F.when(
        (info["Launch Time"] != 0) & (info["Finish Time"] != 0), info["Finish Time"] - info["Launch Time"]
    )

    def number(col: Column) -> Column:
        return F.coalesce(col, F.lit(0))

    return events(lines, "SparkListenerTaskEnd").select(
        "app",
        info["Task ID"].alias("TaskID"),
        F.col("Stage ID").alias("StageID"),
        F.col("Stage Attempt ID").alias("StageAttemptID"),
        info["Executor ID"].alias("ExecutorID"),
        info["Host"].alias("Host"),
        info["Launch Time"].alias("LaunchTime"),
        info["Finish Time"].alias("FinishTime"),
        took.alias("Duration"),
        F.coalesce(info["Successful"], ~info["Failed"]).alias("Successful"),
        number(metrics["Input Metrics"]["Bytes Read"]).alias("BytesRead"),
        number(metrics["Shuffle Read Metrics"]["Remote Bytes Read"]).alias("ShuffleReadBytes"),
        number(metrics["Shuffle Write Metrics"]["Shuffle Bytes Written"]).alias("ShuffleWriteBytes"),
        number(metrics["Memory Bytes Spilled"]).alias("MemoryBytesSpilled"),
        number(metrics["Disk Bytes Spilled"]).alias("DiskBytesSpilled"),
        (took / 1000).alias("DurationSec"),
    )


def history(lines: DataFrame) -> DataFrame:
    """Jobs and stage attempts in one frame, from one pass over the lines.

    A line that names one of the events is parsed once, to a VARIANT that is read out once, and
    gives its rows by event: a job's start and end are two rows of the job, and its start names
    the job of each of its stages. Rows meet by (app, kind, id) in one window, which holds no
    lists, so ends are found in any file of a log, and nothing is joined. Columns: app, Kind
    (job or stage), ID, Attempt, JobID, Name, Result, SubmissionTime, CompletionTime, NumTasks,
    the accumulables (0 where a stage lacks one, null for jobs) and DurationSec. A stage of
    several jobs belongs to the last; a job that has not ended has no end, a stage that was not
    completed no row.
    """
    names = ("SparkListenerJobStart", "SparkListenerJobEnd", "SparkListenerStageCompleted")
    parsed = lines.where(_naming(names)).select("app", F.try_parse_json("value").alias("v"))
    parsed = parsed.select("app", F.try_variant_get("v", "$", _HISTORY).alias("e"))

    def row(**cols: Column) -> Column:
        return F.struct(*[cols.get(n, F.lit(None)).cast(t).alias(n) for n, t in [*_ROW, *_ATTEMPT]])

    e = F.col("e")
    event, job, info = e["Event"], e["Job ID"], e["Stage Info"]
    stage_ids = F.coalesce(e["Stage Infos"]["Stage ID"], F.array().cast("array<bigint>"))
    started = F.concat(
        F.array(row(Kind=F.lit("job"), ID=job, JobID=job, SubmissionTime=e["Submission Time"])),
        F.transform(stage_ids, lambda s: row(Kind=F.lit("stage"), ID=s, JobID=job)),
    )
    ended = F.array(
        row(Kind=F.lit("job"), ID=job, JobID=job, Result=e["Job Result"]["Result"], CompletionTime=e["Completion Time"])
    )
    stage = F.array(
        row(
            Kind=F.lit("stage"), ID=info["Stage ID"], Attempt=F.coalesce(info["Stage Attempt ID"], F.lit(0)),
            Name=F.coalesce(info["Stage Name"], F.lit("unknown")),
            SubmissionTime=info["Submission Time"], CompletionTime=info["Completion Time"],
            NumTasks=F.coalesce(info["Number of Tasks"], F.lit(0)), Accumulables=info["Accumulables"],
        )
    )
    routed = F.when(event == names[0], started).when(event == names[1], ended).when(event == names[2], stage)
    rows = parsed.select("app", F.inline(routed))

    def number(name: str) -> Column:
        hits = F.filter("Accumulables", lambda a: a["Name"] == name)
        return F.when(F.col("Kind") == "stage", F.coalesce(F.get(hits, F.lit(0))["Value"].try_cast("long"), F.lit(0)))

    # numbers in place of the accumulables before rows are moved
    rows = rows.select(*[c for c in rows.columns if c != "Accumulables"], *[number(acc).alias(col) for col, acc in STAGE_ACCUMULABLES.items()])
    # one row per job, and a row per attempt of a stage with the last job that lists it
    is_job = F.col("Kind") == "job"
    by = Window.partitionBy("app", "Kind", "ID").orderBy(F.lit(1))
    all_ = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = rows.select(
        "app", "Kind", "ID", "Attempt", F.max("JobID").over(all_).alias("JobID"), "Name", F.max("Result").over(all_).alias("Result"),
        F.when(is_job, F.min("SubmissionTime").over(all_)).otherwise(F.col("SubmissionTime")).alias("SubmissionTime"),
        F.when(is_job, F.max("CompletionTime").over(all_)).otherwise(F.col("CompletionTime")).alias("CompletionTime"),
        "NumTasks", *STAGE_ACCUMULABLES, F.row_number().over(by).alias("_place"),
    )
    found = found.where(F.when(is_job, (F.col("_place") == 1) & F.col("SubmissionTime").isNotNull()).otherwise(F.col("Attempt").isNotNull()))
    return found.drop("_place").withColumn("DurationSec", (F.col("CompletionTime") - F.col("SubmissionTime")) / 1000)


def summarize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distribution of the numeric columns of jobs or stages."""
    return describe_columns(df, cols)


def summarize_history(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distribution of the numeric columns of `history`: Kind, column, count, mean and so on."""
    wide = df.select("Kind", *[F.col(c).cast("double").alias(c) for c in cols])
    return describe(wide.unpivot(["Kind"], list(cols), "column", "value").where("value is not null"), "value", ["Kind", "column"])


def slowest(df: DataFrame, col: str = "DurationSec", n: int = 5, tie: Sequence[str] = ()) -> DataFrame:
    """The n largest rows by `col`."""
    return df.orderBy(F.desc_nulls_last(col), *tie).limit(n)


def job_type(job_id: Column | str) -> Column:
    names = F.create_map(*[F.lit(x) for kv in JOB_TYPES.items() for x in kv])
    return F.coalesce(names[F.pmod(as_column(job_id), F.lit(3)).cast("int")], F.lit("Unknown Job"))


def stage_series(df: DataFrame, zone: str = "America/Sao_Paulo") -> DataFrame:
    """Stages of `history` by local start time, with the type of their job and the mean over
    all stages."""
    return duration_series(df.where("Kind = 'stage'"), zone=zone)


def duration_series(df: DataFrame, time: str = "SubmissionTime", zone: str = "America/Sao_Paulo") -> DataFrame:
    """Durations with local start time, job type and the mean over all rows, which are made and
    written once, since the mean has to be known before the first of them."""
    df = kept(df, "durations")
    overall = df.agg(F.avg("DurationSec").alias("m")).scalar()
    return df.withColumns(
        {
            "StartedAt": to_zone(F.timestamp_millis(F.col(time)), zone),
            "JobType": job_type("JobID"),
            "MeanSec": overall,
        }
    )
