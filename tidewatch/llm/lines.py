"""Line dedup by site-relative frequency.

Pages are grouped by host. A line's ratio is the number of the host's pages that contain
it, divided by the host's page total; lines above the boilerplate ratio are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import keep, whole_text, word_key

RATIO = 0.05
#: A line on fewer pages is no boilerplate, whatever the size of its host.
MIN_SUPPORT = 3
#: The boilerplate lines of all hosts may be broadcast up to so many bytes.
BROADCAST_BYTES = 16 * 1024 * 1024


def line_key(line: Column) -> Column:
    """128 bits that stand for a line, without white space at its ends; null for a blank line."""
    bare = F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(bare != "", F.unhex(F.md5(bare.cast("binary"))))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_support: int = MIN_SUPPORT) -> DataFrame:
    """(_host, _keys): per host the keys of its lines on more than `ratio` of its pages and
    on `min_support` of them at least.

    Pages of a host with the same words count as one, so whole copies make no line frequent,
    and a page counts once for a line however often the line is on it. A host's array has at
    most (mean lines per page) / ratio keys, whatever the number of its pages. Lines are
    counted on the map side before anything is shuffled, so hot hosts and hot lines cost one
    row per task: first by rows, which are no fewer than pages, and only the lines that are
    frequent by rows are then counted by pages.
    """
    pages = docs.select(F.col(host).alias("_host"), whole_text(text).alias("_text"))
    texts = pages.select("_host", F.unhex(word_key(F.col("_text"))).alias("_page")).distinct()
    totals = keep(texts.groupBy("_host").agg(F.count(F.lit(1)).alias("_pages")), "line-totals")
    keys = F.array_distinct(F.transform(_lines(F.col("_text")), line_key))

    def frequent(counted: DataFrame) -> DataFrame:
        enough = counted.where(F.col("_on") >= min_support).withColumnRenamed("_host", "_h")
        enough = enough.join(totals, F.col("_h").eqNullSafe(F.col("_host"))).where(F.col("_on") > F.lit(ratio) * F.col("_pages"))
        return enough.groupBy("_host").agg(F.collect_list("_key").alias("_keys"))

    counted = pages.select("_host", F.explode(keys).alias("_key")).where("_key is not null")
    some = frequent(counted.groupBy("_host", "_key").agg(F.count(F.lit(1)).alias("_on")))
    some = keep(some, "line-candidates").withColumnRenamed("_host", "_h")
    near = pages.join(_at_hand(some, "_h"), F.col("_host").eqNullSafe(F.col("_h")))
    near = near.select("_host", F.unhex(word_key(F.col("_text"))).alias("_page"), F.explode(F.array_intersect(keys, "_keys")).alias("_key"))
    return frequent(near.distinct().groupBy("_host", "_key").agg(F.count(F.lit(1)).alias("_on")))


def _at_hand(found: DataFrame, host: str = "_host") -> DataFrame:
    """Kept keys of hosts as the side of a join with the pages: broadcast when they are few."""
    bytes_ = F.sum(F.size("_keys") * 24 + F.coalesce(F.octet_length(host), F.lit(0)) + 64)
    small = found.agg(F.coalesce(bytes_, F.lit(0)).alias("b")).first()["b"] <= BROADCAST_BYTES
    return F.broadcast(found) if small else found


def dedup_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Every row of `docs` with its boilerplate lines taken out of `text`, plus `n_lines`
    and `n_dropped`.

    Blank lines are kept and not counted as boilerplate; `n_lines` counts all lines. A null
    text stays null with no lines; rows with a null host form one host. Rows of a host with
    the same words, repeated ones among them, count as one page, and lose the same lines. A
    page whose every line is boilerplate stays, with an empty text. Columns named n_lines or
    n_dropped in the input are replaced, other columns stay. An empty table gives an empty one.
    """
    found = keep(boilerplate(docs, host, text, ratio, min_support), "line-boilerplate")
    joined = docs.join(_at_hand(found), F.col(host).eqNullSafe(F.col("_host")), "left")
    lines = _lines(F.col(text))
    kept = F.filter(
        F.col("_split"), lambda x: ~F.coalesce(F.array_contains(F.col("_keys"), line_key(x)), F.lit(False))
    )
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    joined = joined.withColumn("_split", lines)
    joined = joined.withColumn("_left", F.when(F.col("_keys").isNull(), F.col("_split")).otherwise(kept))
    return joined.select(
        *[F.array_join("_left", "\n").alias(c) if c == text else F.col(c) for c in own],
        F.coalesce(F.size("_split"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_split") - F.size("_left"), F.lit(0)).cast("long").alias("n_dropped"),
    )
