"""Pod life cycle from phase samples (POD)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.naming import (
    DRIVER_PATTERNS,
    WORKER_PATTERNS,
    component_name,
    matches_any,
    starts_with_any,
)
from tidewatch.functions.timeutil import extent, seconds_between
from tidewatch.operators.joins import attach, sized
from tidewatch.operators.ordered import Ordered

# Phases that may end a run.
ENDING_PHASES = ["Failed", "Succeeded", "Pending", "Unknown"]


def active(df: DataFrame) -> DataFrame:
    """The phase a pod is in: samples with value 1."""
    return df.where(F.col("value") == 1.0)


def phase_segments(
    df: DataFrame,
    by: Sequence[str] = ("pod",),
    ts: str = "timestamp",
    phase: str = "phase",
    tie: Sequence[str] = (),
) -> DataFrame:
    """Runs of equal consecutive phase: by, segment, phase, start, end, samples."""

    def mark(rows: DataFrame) -> DataFrame:
        changed = F.col("_prev1").isNull() | ~F.col(phase).eqNullSafe(F.col(f"_prev1.{phase}"))
        return rows.withColumn("_new", changed.cast("int"))

    o = Ordered(df.select(*by, ts, phase, *tie), by, [ts, *tie]).lag([phase]).then(mark)
    return (
        o.running_sum(F.col("_new"), "segment")
        .result()
        .groupBy(*by, F.col("segment").cast("long").alias("segment"))
        .agg(
            F.max(phase).alias(phase),
            F.min(ts).alias("start_ts"),
            F.max(ts).alias("end_ts"),
            F.count(F.lit(1)).alias("samples"),
        )
    )


def running_intervals(
    df: DataFrame,
    by: Sequence[str] = ("pod",),
    ts: str = "timestamp",
    *,
    gap: float = 45,
    min_dur: float = 5,
    floor: float = 30,
    origin=None,
    namespace: str | None = "namespace",
    tie: Sequence[str] = (),
) -> DataFrame:
    """Continuous running blocks: a step longer than `gap` seconds starts a new one.

    Blocks shorter than `min_dur` count as `floor` seconds. With an `origin` the
    start is also given in seconds from it.
    """
    extra = [namespace] if namespace else []

    def mark(rows: DataFrame) -> DataFrame:
        step = seconds_between(ts, f"_prev1.{ts}")
        return rows.withColumn("_new", (F.col("_prev1").isNull() | (step > gap)).cast("int"))

    o = Ordered(df.select(*by, ts, *extra, *tie), by, [ts, *tie]).lag([ts]).then(mark)
    blocks = (
        o.running_sum(F.col("_new"), "_block")
        .result()
        .groupBy(*by, "_block")
        .agg(
            F.min(ts).alias("start_ts"),
            F.max(ts).alias("end_ts"),
            *[F.min_by(c, ts).alias(c) for c in extra],
        )
    )
    seconds = seconds_between("end_ts", "start_ts")
    out = blocks.withColumn("duration_s", F.when(seconds < min_dur, F.lit(float(floor))).otherwise(seconds))
    if origin is not None:
        out = out.withColumn("start_offset_s", seconds_between("start_ts", F.lit(origin)))
    return out.drop("_block")


def scrape_gaps(
    df: DataFrame, ts: str = "timestamp", by: Sequence[str] = ("environment",), threshold: float = 45, origin=None
) -> DataFrame:
    """Steps between distinct sample times longer than `threshold` seconds."""
    o = Ordered(df.select(*by, ts).distinct(), by, [ts]).lag([ts])
    gaps = (
        o.result()
        .withColumn("duration_s", seconds_between(ts, f"_prev1.{ts}"))
        .where(F.col("duration_s") > threshold)
        .select(*by, F.col(f"_prev1.{ts}").alias("gap_start"), F.col(ts).alias("gap_end"), "duration_s")
    )
    if origin is None:
        return gaps
    return gaps.withColumns(
        {
            "start_offset_s": seconds_between("gap_start", F.lit(origin)),
            "end_offset_s": seconds_between("gap_end", F.lit(origin)),
        }
    )


def restarts(
    df: DataFrame,
    by: Sequence[str] = ("pod",),
    ts: str = "timestamp",
    phase: str = "phase",
    tie: Sequence[str] = (),
) -> DataFrame:
    """Changes into Pending and the first Running time after each, null if there is none."""
    rows = active(df).withColumn("_late", (F.col(phase) != "Running").cast("int"))
    rows = rows.select(*by, ts, phase, "_late", *tie)
    o = Ordered(rows, by, [ts, "_late", *tie]).lag([phase])
    o = o.nearest_known(F.when(F.col(phase) == "Running", F.col(ts)), "running_time", after=True)
    went = (F.col(phase) == "Pending") & (F.col(f"_prev1.{phase}") != "Pending")
    return o.result().where(went).select(*by, F.col(ts).alias("restart_time"), "running_time")


def service_restarts(df: DataFrame, prefixes: Sequence[str], **kwargs) -> DataFrame:
    """Restarts of one service's pods, the events drawn over its panel."""
    return restarts(df.where(starts_with_any("pod", prefixes)), **kwargs)


def true_starts(
    df: DataFrame, by: Sequence[str] = ("pod",), ts: str = "timestamp", phase: str = "phase"
) -> DataFrame:
    """First Running time of driver and executor pods that is a real start.

    A Running sample counts if nothing but Running follows, or if some later
    sample has a known phase. Later phases of another name alone rule it out.
    """
    pods = active(df).where(F.lower("pod").rlike("driver|exec")).select(*by, ts, phase)
    known, running = F.col(phase).isin(ENDING_PHASES), F.col(phase) == "Running"
    seen = pods.groupBy(*by).agg(
        F.min(F.when(running, F.col(ts))).alias("_first"),
        F.max(F.when(known, F.col(ts))).alias("_known"),
        F.max(F.when(~known & ~running, F.col(ts))).alias("_other"),
    )
    simple = F.col("_other").isNull() | (F.col("_first") >= F.col("_other")) | (F.col("_first") < F.col("_known"))
    seen = seen.where(F.col("_first").isNotNull()).withColumn("_simple", F.coalesce(simple, F.lit(False)))
    # only pods with an unknown phase name look at their rows again
    odd = seen.where(~F.col("_simple"))
    late = (
        attach(pods.where(running), odd.select(*by, "_other"), by, how="inner")
        .where(F.col(ts) >= F.col("_other"))
        .groupBy(*by)
        .agg(F.min(ts).alias("start_ts"))
    )
    plain = seen.where("_simple").select(*by, F.col("_first").alias("start_ts"))
    return plain.unionByName(late)


def warmup(
    df: DataFrame,
    by: Sequence[str] = ("environment",),
    ts: str = "timestamp",
    driver_patterns: Sequence[str] = DRIVER_PATTERNS,
    worker_patterns: Sequence[str] = WORKER_PATTERNS,
) -> DataFrame:
    """From the first driver Running to the last executor's first Running; null if not after."""
    running = active(df).where(F.col("phase") == "Running")
    firsts = running.groupBy(*by, "pod").agg(F.min(ts).alias("_first"))
    driver, worker = matches_any("pod", driver_patterns), matches_any("pod", worker_patterns)
    out = firsts.groupBy(*by).agg(
        F.min(F.when(driver, F.col("_first"))).alias("warm_start"),
        F.max(F.when(worker, F.col("_first"))).alias("warm_end"),
    )
    seconds = seconds_between("warm_end", "warm_start")
    return out.withColumn("warmup_s", F.when(seconds > 0, seconds))


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """Row numbers from 1 within each group, without a task per group.

    Spark sorts all rows by range. A row's number in its part comes from a window over
    (part, group); a group's rows in the parts before are added up from one row per part and
    group. Parts are balanced however large a group is.
    """
    keys = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))
    sorted_ = df.select("*", keys.alias("_key")).repartitionByRange("_key", *order)
    rows = sorted_.withColumn("_part", F.spark_partition_id())
    # numbers of parts are not the same when a plan is cut up anew, so the rows are kept
    rows, _ = sized(rows, "numbered")
    within = Window.partitionBy("_part", "_key").orderBy(*order)
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_part", "_key").agg(F.count(F.lit(1)).alias("_n"))
    parts = parts.select("_part", "_key", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = rows.withColumn("_at", F.row_number().over(within)).join(parts, ["_part", "_key"])
    return out.select(*df.columns, (F.col("_at") + F.col("_before")).alias(name))


def role_labels(
    df: DataFrame,
    by: Sequence[str] = ("environment",),
    driver_patterns: Sequence[str] = DRIVER_PATTERNS,
    worker_patterns: Sequence[str] = WORKER_PATTERNS,
) -> DataFrame:
    """Display name per pod: spark-driver, spark-worker-<n> by trailing number, or its own name.

    Only workers are numbered; the driver with the first name is the driver.
    """
    pods = df.select(*by, "pod").distinct()
    worker = matches_any("pod", worker_patterns)
    driver = matches_any("pod", driver_patterns) & ~worker
    pods = pods.withColumn("role", F.when(worker, "worker").when(driver, "driver").otherwise("other"))
    workers = pods.where("role = 'worker'").withColumn("_no", F.regexp_extract("pod", r"(\d+)$", 1).try_cast("long"))
    workers = numbered(workers, by, [F.col("_no").asc_nulls_last(), F.col("pod")], "_rank")
    workers = workers.select(*by, "pod", "role", F.concat(F.lit("spark-worker-"), F.col("_rank").cast("string")).alias("label"))
    others = pods.where("role <> 'worker'")
    first = others.where("role = 'driver'").groupBy(*by).agg(F.min("pod").alias("_first"))
    label = F.when((F.col("role") == "driver") & (F.col("pod") == F.col("_first")), "spark-driver").otherwise(F.col("pod"))
    return workers.unionByName(attach(others, first, by).select(*by, "pod", "role", label.alias("label")))


def starts_on_node(starts: DataFrame, usage: DataFrame, node: str) -> DataFrame:
    """Start events of pods that have samples on `node`."""
    there = usage.where(F.col("node") == node).select("pod").distinct()
    return starts.join(there, "pod", "left_semi")


def disruption(
    df: DataFrame,
    spans: Mapping[str, tuple],
    names: Mapping[str, str],
    *,
    namespaces: Sequence[str],
    reported: Sequence[str],
    gap: float = 45,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Running intervals of the reported components in every environment of `spans`, which
    gives its start and end; offsets count from the environment's own start.

    `names` maps prefixes of pod names to components; `reported` are prefixes of components.
    """

    def one(environment: str, start, end) -> DataFrame:
        rows = active(df).where((F.col("environment") == environment) & F.col("timestamp").between(F.lit(start), F.lit(end)))
        rows = rows.where(F.col("namespace").isin(list(namespaces)) & (F.col("phase") == "Running"))
        found = running_intervals(rows, gap=gap, origin=start, tie=tie)
        return found.withColumns({"environment": F.lit(environment), "component": component_name("pod", names)})

    out = reduce(DataFrame.unionByName, [one(e, *span) for e, span in spans.items()])
    return out.where(starts_with_any("component", reported))


def disruption_gaps(df: DataFrame, spans: Mapping[str, tuple], threshold: float = 45) -> DataFrame:
    """Times without any sample of an environment, all its pods together, within its span."""

    def one(environment: str, start, end) -> DataFrame:
        rows = df.where((F.col("environment") == environment) & F.col("timestamp").between(F.lit(start), F.lit(end)))
        return scrape_gaps(rows, threshold=threshold, origin=start)

    return reduce(DataFrame.unionByName, [one(e, *span) for e, span in spans.items()])


def availability(intervals: DataFrame, gaps: DataFrame, spans: Mapping[str, tuple]) -> DataFrame:
    """Per environment and component: seconds up (some pod running while samples came), seconds
    unseen (no samples), seconds down (the rest of the span), and `max_span_s`, the longest
    span, which is the common axis of all.

    A sweep: an interval adds one where it starts and takes one where it ends, a gap likewise;
    the running sums hold until the next change. Changes at one time are added up first, so
    overlapping pods and thousands of intervals of one component cost one row per time.
    """
    seconds = {e: (end - start).total_seconds() for e, (start, end) in spans.items()}
    keys = ["environment", "component"]
    every = intervals.select(*keys).distinct()

    def changes(rows: DataFrame, start: str, end: str, up: int) -> DataFrame:
        at = F.explode(F.array(F.struct(F.col(start).alias("ts"), F.lit(1).alias("_d")), F.struct(F.col(end).alias("ts"), F.lit(-1).alias("_d"))))
        rows = rows.select(*keys, at.alias("_c")).select(*keys, "_c.ts", "_c._d")
        return rows.select(*keys, "ts", (F.col("_d") * up).alias("_up"), (F.col("_d") * (1 - up)).alias("_gap"))

    edges = F.lit(None).cast("timestamp")
    for e, (start, end) in spans.items():
        edges = F.when(F.col("environment") == e, F.lit(start)).otherwise(edges)
    last = F.lit(None).cast("timestamp")
    for e, (start, end) in spans.items():
        last = F.when(F.col("environment") == e, F.lit(end)).otherwise(last)
    whole = every.select(*keys, F.explode(F.array(edges, last)).alias("ts"), F.lit(0).alias("_up"), F.lit(0).alias("_gap"))
    moves = (
        changes(intervals, "start_ts", "end_ts", 1)
        .unionByName(changes(every.join(gaps, "environment"), "gap_start", "gap_end", 0))
        .unionByName(whole)
        .groupBy(*keys, "ts")
        .agg(F.sum("_up").alias("_up"), F.sum("_gap").alias("_gap"))
    )
    # both sums in one step: neither is ever below zero, so they share a long
    both = F.col("_gap") * F.lit(1 << 32) + F.col("_up")
    o = Ordered(moves.select(*keys, "ts", both.alias("_both")), keys, ["ts"]).running_sum(F.col("_both"), "_now").lag(["ts", "_now"])
    held = seconds_between("ts", "_prev1.ts")
    unseen, up = F.shiftright("_prev1._now", 32) > 0, F.col("_prev1._now").bitwiseAND(F.lit((1 << 32) - 1)) > 0
    span = F.create_map(*[F.lit(x) for pair in seconds.items() for x in pair])
    total = lambda cond: F.coalesce(F.sum(F.when(cond, held)), F.lit(0.0))
    out = o.result().groupBy(*keys).agg(total(up & ~unseen).alias("up_s"), total(unseen).alias("unseen_s"))
    down = span[F.col("environment")] - F.col("up_s") - F.col("unseen_s")
    return out.withColumns({"down_s": down, "max_span_s": F.lit(max(seconds.values()))})


def common_span(frames: Sequence[DataFrame], ts: str = "timestamp") -> DataFrame:
    """The longest span in seconds over several environments."""
    out = None
    for df in frames:
        one = extent(df, ts).select(seconds_between("last_ts", "first_ts").alias("_span"))
        out = one if out is None else out.unionByName(one)
    return out.agg(F.max("_span").alias("max_span_s"))
