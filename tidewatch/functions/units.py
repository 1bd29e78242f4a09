"""Unit conversion and constant tags (PRJ9, PRJ10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Factor from the recorded unit to the reported one.
FACTORS = {
    "bytes_to_kib": 1 / 1024,
    "bytes_to_mib": 1 / 1024**2,
    "bytes_to_gib": 1 / 1024**3,
    "s_to_ms": 1000.0,
    "cpu_to_percent": 100.0,
}


def convert_unit(col: Column | str, unit: str, digits: int | None = None) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    out = c * F.lit(FACTORS[unit])
    return out if digits is None else F.round(out, digits)


def tag(df: DataFrame, **constants: str) -> DataFrame:
    """Constant columns, for example the environment before a union."""
    return df.withColumns({k: F.lit(v) for k, v in constants.items()})
