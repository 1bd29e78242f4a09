"""Column functions on times (TIM)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.joins import attach

# ISO-8601 spellings met in source timestamps, after the native parser.
ISO_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd HH:mm:ssX", "yyyy-MM-dd'T'HH:mmX"]


def as_column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def micros(col: Column | str) -> Column:
    return F.unix_micros(as_column(col).cast("timestamp"))


def normalize_ts(col: Column | str, kind: str = "iso", shift_hours: float = 0) -> Column:
    """Source time in any of its recorded forms as a UTC timestamp.

    `iso` takes text in mixed ISO-8601 spellings (no offset means UTC), `epoch_ms`
    and `epoch_s` take numbers, `any` takes text that is either. A shift moves the
    instant and leaves the zone alone; unreadable input becomes null.
    """
    c = as_column(col)
    if kind == "iso":
        text = F.trim(c.cast("string"))
        tries = [F.expr("null").cast("timestamp"), text.try_cast("timestamp")]
        tries += [F.try_to_timestamp(text, F.lit(f)) for f in ISO_FORMATS]
        out = F.coalesce(*tries)
    elif kind == "epoch_ms":
        out = F.timestamp_millis(c.try_cast("long"))
    elif kind == "epoch_s":
        out = F.timestamp_micros(F.round(c.try_cast("double") * 1e6).cast("long"))
    elif kind == "any":
        text = F.trim(c.cast("string"))
        out = F.when(text.rlike("^-?\\d+$"), F.timestamp_millis(text.try_cast("long"))).otherwise(
            normalize_ts(text, "iso")
        )
    else:
        raise ValueError(f"unknown time kind: {kind}")
    return shift(out, shift_hours)


def shift(col: Column | str, hours: float) -> Column:
    """Move the instant by a fixed number of hours."""
    c = as_column(col)
    if not hours:
        return c
    return c + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600.0))


def to_zone(col: Column | str, zone: str = "America/Sao_Paulo") -> Column:
    """Wall-clock time in `zone` (a timestamp without zone) of a UTC instant."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), as_column(col).cast("timestamp_ntz"))


def seconds_between(later: Column | str, earlier: Column | str, truncate: bool = False) -> Column:
    """later - earlier in seconds; `truncate` cuts both to whole seconds first."""
    if truncate:
        a, b = F.floor(micros(later) / 1_000_000), F.floor(micros(earlier) / 1_000_000)
        return (a - b).cast("long")
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def extent(df: DataFrame, ts: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def relative_seconds(
    df: DataFrame,
    ts: str,
    by: Sequence[str] = (),
    *,
    whole: bool = False,
    few_groups: bool = False,
    name: str = "relative_s",
) -> DataFrame:
    """Seconds since the first sample of the group.

    `whole` gives the seconds part of the difference only, which starts over
    after a day.
    """
    starts = df.groupBy(*by).agg(F.min(ts).alias("_start"))
    out = attach(df, starts, by, few_groups=few_groups)
    rel = seconds_between(ts, "_start")
    if whole:
        rel = (F.floor(rel) % 86400).cast("long")
    return out.withColumn(name, rel).drop("_start")


def bucket(ts: Column | str, seconds: int, *, any_step: bool = False) -> Column:
    """Start of the fixed interval that holds `ts`, counted from midnight UTC."""
    if not any_step and 86400 % seconds:
        raise ValueError(f"step of {seconds} s does not divide a day")
    size = seconds * 1_000_000
    return F.timestamp_micros(micros(ts) - F.pmod(micros(ts), F.lit(size)))


def format_duration(seconds: Column | str) -> Column:
    """12.3s, 4m05.6s or 1h02m03.4s."""
    s = as_column(seconds).cast("double")
    h, m, rest = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    return (
        F.when(s >= 3600, F.format_string("%dh%02dm%04.1fs", h, m, rest))
        .when(s >= 60, F.format_string("%dm%04.1fs", F.floor(s / 60), rest))
        .otherwise(F.format_string("%.1fs", s))
    )


def format_clock(ts: Column | str, zone: str = "America/Sao_Paulo") -> Column:
    return F.date_format(to_zone(ts, zone), "HH'h'mm'm'ss's'")


def stamp_landing(df: DataFrame, name: str = "landing_timestamp") -> DataFrame:
    """Arrival time: one value per query or micro-batch."""
    return df.withColumn(name, F.current_timestamp())


def stamp_source(df: DataFrame, style: str = "epoch_ms", name: str = "source_timestamp") -> DataFrame:
    """Send time as epoch milliseconds or ISO-8601 text."""
    if style == "epoch_ms":
        return df.withColumn(name, F.unix_millis(F.current_timestamp()))
    if style == "iso":
        return df.withColumn(name, F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    raise ValueError(f"unknown stamp style: {style}")
