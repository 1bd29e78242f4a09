"""Pod names: short names, service groups, labels (POD8-POD12). Callers bring their own tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.timeutil import as_column

# Names that Spark gives its pods on Kubernetes.
DRIVER_PATTERNS = [r"-driver$"]
WORKER_PATTERNS = [r"-exec-\d+$"]


def starts_with_any(col: Column | str, prefixes: Sequence[str]) -> Column:
    cond = F.lit(False)
    for p in prefixes:
        cond = cond | as_column(col).startswith(p)
    return cond


def matches_any(col: Column | str, patterns: Sequence[str]) -> Column:
    return as_column(col).rlike("|".join(f"(?:{p})" for p in patterns))


def _prefix_name(col: Column, names: Mapping[str, str]) -> tuple[Column, Column]:
    """The first listed prefix `col` starts with (empty if none) and the name it stands for."""
    if not names:
        return F.lit(""), F.lit(None).cast("string")
    prefix = F.regexp_extract(col, f"^({'|'.join(re.escape(p) for p in names)})", 1)
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return prefix, F.try_element_at(table, prefix)


def short_name(pod: Column | str, names: Mapping[str, str]) -> Column:
    """Readable pod name: generated suffixes dropped, a prefix listed in `names` swapped for
    its name with the rest kept, other names cut to three parts."""
    # What counts as a generated suffix.
    bare = F.regexp_replace(as_column(pod), r"-[a-z0-9]{5,}(?=$|-)", "")
    bare = F.regexp_replace(bare, r"-[a-z0-9]{8,}$", "")
    parts = F.split(bare, "-")
    rest = F.when(F.size(parts) > 3, F.array_join(F.slice(parts, 1, 3), "-")).otherwise(bare)
    prefix, name = _prefix_name(bare, names)
    return F.when(prefix != "", F.replace(bare, prefix, name)).otherwise(rest)


def component_name(pod: Column | str, names: Mapping[str, str], executor: str = "spark-executor-") -> Column:
    """The component a pod belongs to by its prefix in `names`; executors keep their number,
    other pods their name."""
    c = as_column(pod)
    number = F.regexp_extract(c, r"-exec-(\d+)$", 1)
    _, name = _prefix_name(c, names)
    return F.coalesce(F.when(number != "", F.concat(F.lit(executor), number)), name, c)


def service_group(pod: Column | str, groups: Mapping[str, Sequence[str]]) -> Column:
    """The service whose prefixes a pod name starts with, null if none."""
    _, name = _prefix_name(as_column(pod), {p: g for g, prefixes in groups.items() for p in prefixes})
    return name


def start_label(pod: Column | str) -> Column:
    """Driver, Exc-<number>, or the pod name itself."""
    c = as_column(pod)
    return (
        F.when(c.contains("driver"), F.lit("Driver"))
        .when(c.contains("exec"), F.concat(F.lit("Exc-"), F.element_at(F.split(c, "-exec-"), -1)))
        .otherwise(c)
    )
