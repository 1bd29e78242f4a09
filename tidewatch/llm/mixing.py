"""Mixing sources to target weights.

Tokens (words) are summed per source, the sums give each source a target and a
repetition rate, and every document is taken floor(rate) times plus once more with
the probability of the fraction, decided by a hash of its id and text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import keep, whole_text, word_count

#: A per-source table of at most so many bytes (ids and five numbers each) may be broadcast.
BROADCAST_BYTES = 8 * 1024 * 1024


def _ranked(sources: DataFrame) -> DataFrame:
    """Number the sources by code point, null last, without one task for all of them.

    Spark sorts by range; a row's number is its place in its part plus the rows of
    the parts before, of which there is one row per part.
    """
    by_range = keep(
        sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()),
        "mix-sources",
    ).withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        by_range.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")
    return by_range.join(parts, "_part").select("source", "source_size", "n_docs", place.alias("place"))


def source_targets(sized: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size, n_docs, target) from rows (source, size).

    Weights repeat over the sources by code point, null last. All sizes together are
    shared by weight; a target stops at `cap` times its source's size and what is above
    is shared again by weight until none is above. Each turn of that is one small
    aggregate over the sources; no more than the numbers of one row come to the driver.
    Without any words every target is 0.
    """
    ranked = _ranked(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = keep(ranked.select("source", "source_size", "n_docs", weight.cast("long").alias("weight")), "mix-weights")
    ceiling = F.col("source_size") * cap

    def share(level: float | None):
        over = F.lit(False) if level is None else F.lit(level) * F.col("weight") > ceiling
        row = weighed.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"),
            F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("weight"),
            F.count(F.when(over, 1)).alias("n"),
        ).first()
        return row, ((row["total"] - cap * row["capped"]) / row["weight"] if row["weight"] else 0.0)

    row, level = share(None)
    while True:
        again, raised = share(level)
        if again["n"] == row["n"]:
            break
        row, level = again, raised
    capped = F.lit(level) * F.col("weight") > ceiling
    target = F.when(capped, ceiling.cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return weighed.select("source", "source_size", "n_docs", target.alias("target"))


def row_key(doc_id: Column, text: Column) -> Column:
    """What a row is drawn by: its id and the MD5 of its text."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def draw(key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone: 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds `_draw`: the key, and for rows that repeat a key the row's number in the table."""
    docs = docs.withColumn("_draw", row_key(F.col("doc_id"), F.col("text")))
    twice = docs.groupBy("_draw").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("_draw").alias("_twice"))
    twice = keep(twice, "mix-repeated")
    n = twice.count()
    if not n:
        return docs
    right = F.broadcast(twice) if n * 64 <= BROADCAST_BYTES else twice
    numbered = docs.withColumn("_row", F.monotonically_increasing_id()).join(right, F.col("_draw") == F.col("_twice"), "left")
    number = F.when(F.col("_twice").isNotNull(), F.concat(F.col("_draw"), F.lit(":"), F.col("_row").cast("string")))
    return numbered.withColumn("_draw", F.coalesce(number, "_draw")).drop("_row", "_twice")


def plan_mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Every row of `docs` with `size`, `source_size`, `target` and `copies`.

    `size` counts words (null text: 0). Rows that repeat a doc_id are rows like any
    other and draw each, by id and text, and where these repeat too by their number in the
    table. A source's taken words come near its target as chance has it: by about the square
    root of the sum of its documents' squared sizes. A null source is a source of its own, sorted last.
    Columns of these four names in the input are replaced, other columns stay.
    A source without words has rate 0, so its documents are not taken. An empty table
    gives an empty one.

    Only (source, size) is shuffled, added up on the map side, so a hot source costs one
    row per task; the documents themselves are not moved while the table of sources is
    small, which is measured.
    """
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "_draw")]
    sized = _keyed(docs.select(*own)).withColumn("size", word_count(whole_text()))
    targets = keep(source_targets(docs.select("source", word_count(whole_text()).alias("size")), weights, cap), "mix-targets")
    small = targets.agg(
        F.coalesce(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + F.lit(64)), F.lit(0)).alias("bytes")
    ).first()["bytes"]
    right = targets.select(F.col("source").alias("_mix_source"), "source_size", "target")
    if small <= BROADCAST_BYTES:
        right = F.broadcast(right)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = sized.join(right, F.col("source").eqNullSafe(F.col("_mix_source")), "left")
    extra = F.when(draw(F.col("_draw")) < rate - F.floor(rate), 1).otherwise(0)
    return joined.select(*own, "size", "source_size", "target", (F.floor(rate) + extra).cast("int").alias("copies"))


def take_mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """The mix itself: each row of `docs` as often as it is taken, with its own columns."""
    planned = plan_mix(docs, weights, cap).where("copies > 0")
    return planned.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*docs.columns)
