"""Exact quantiles by radix selection, without moving or sorting rows.

A double is read as a 64-bit whole number of the same order. Its first 24 bits are counted
on the map side, which leaves 4096 counts per group, task and power of two to be added up;
they tell which of them hold the wanted ranks. Rows that start with those bits are counted
by their next 20 bits, those left by the last 20, and then every wanted rank is one value.
All ranks of all columns go together. Where values lie makes no difference: a dense cluster
far from an outlier takes the same three turns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.joins import kept, sized

#: Bits of a value that are known after each turn.
TURNS = (24, 44, 64)
_ONE = 1 << 52


def with_ordered_bits(df: DataFrame, col: str, out: str = "_bits") -> DataFrame:
    """Adds the bits of a double as a long of the same order; -0.0 is 0.0, null and NaN are null.

    Java gives the bits. Worked out from logarithm and powers they made generated code too long
    to be compiled, 17 microseconds a row.
    """
    d = F.col(col).cast("double")
    plain = F.when(d == 0, F.lit(0.0)).otherwise(d)
    raw = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), plain).cast("long")
    df = df.withColumn("_m", F.when(d.isNotNull() & ~F.isnan(d), raw))
    signed = F.when(F.col("_m") < 0, F.bitwise_not(F.col("_m").bitwiseAND(F.lit((1 << 63) - 1)))).otherwise(F.col("_m"))
    return df.withColumn(out, signed).drop("_m")


def from_ordered_bits(bits: Column) -> Column:
    """The double that `with_ordered_bits` gave these bits."""
    m = F.when(bits < 0, -bits - 1).otherwise(bits)
    e, part = F.shiftright(m, 52), m.bitwiseAND(F.lit(_ONE - 1)).cast("double")
    normal = (1 + part / F.lit(float(_ONE))) * F.pow(F.lit(2.0), (e - 1023).cast("double"))
    size = F.when(e == 0x7FF, F.lit(float("inf"))).when(e > 0, normal).otherwise(part * F.lit(2.0**-537) * F.lit(2.0**-537))
    return F.when(bits < 0, -size).otherwise(size)


def value_counts(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """(by, _v, _c): each distinct non-null value of a group and how often it occurs."""
    v = F.col(col).cast("double")
    return (
        df.select(*by, v.alias("_v"))
        .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .groupBy(*by, "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )


def _ranks(probs: Sequence[float], n: Column) -> list[tuple[Column, Column, Column]]:
    out = []
    for p in probs:
        pos = F.lit(float(p)) * (n - 1)
        out.append((F.floor(pos), F.ceil(pos), pos - F.floor(pos)))
    return out


def _found(counts: DataFrame, within: Sequence[str], turn: int, probs: Sequence[float]) -> DataFrame:
    """The prefixes that hold a wanted rank: `_rest` has those ranks (`rank`) and how many
    values of the prefix come before each (`left`)."""
    over = Window.partitionBy(*within).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(over), F.lit(0)))
    if turn == 0:
        counts = counts.withColumn("_n", F.sum("_c").over(Window.partitionBy(*within)))
        wanted = F.array_distinct(F.array(*[r for lo, hi, _ in _ranks(probs, F.col("_n")) for r in (lo, hi)]))
        wanted = F.transform(wanted, lambda r: F.struct(r.alias("rank"), r.alias("left")))
    else:
        wanted = F.col("_rest")
    inside = F.filter(wanted, lambda w: (w["left"] >= F.col("_before")) & (w["left"] < F.col("_before") + F.col("_c")))
    rest = F.transform(inside, lambda w: F.struct(w["rank"].alias("rank"), (w["left"] - F.col("_before")).alias("left")))
    return counts.withColumn("_rest", rest).where(F.size("_rest") > 0).drop("_before", "_c")


def exact_ranks(df: DataFrame, by: Sequence[str], cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(by, _col, n, q): linearly interpolated quantiles at `probs` of each of `cols`, `_col`
    being its number. Nulls and NaN are skipped; groups without a value have no row.

    A turn has at most two prefixes per group, column and probability. Those of the first
    one are written out and counted; where they are few, as are the later ones then, they
    are broadcast, and rows are counted where they are. Else Spark picks the join.
    """
    one = [F.struct(F.lit(i).alias("_col"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(cols)]
    names = [f"_k{i}" for i in range(len(by))]
    keys = [F.col(k).alias(n) for k, n in zip(by, names, strict=True)]
    rows = df.select(*keys, F.inline(F.array(*one))) if len(one) > 1 else df.select(*keys, F.lit(0).alias("_col"), one[0]["_v"].alias("_v"))
    # the turns read group and bits alone, written once where they are, whatever made the rows
    rows = kept(with_ordered_bits(rows, "_v").where("_bits is not null").drop("_v"), "rank-bits")
    group, found, few = [*names, "_col"], None, False
    for turn, bits in enumerate(TURNS):
        prefix = F.shiftright("_bits", 64 - bits).alias("_p")
        some, within = rows, [*group]
        if found is not None:
            last = F.shiftright("_bits", 64 - TURNS[turn - 1])
            right = found.select(*[F.col(c).alias(f"_r{c}") for c in group], F.col("_p").alias("_of"), "_n", "_rest")
            right = F.broadcast(right) if few else right
            same = last == F.col("_of")
            for c in group:
                same = same & F.col(c).eqNullSafe(F.col(f"_r{c}"))
            some, within = rows.join(right, same), [*group, "_of"]
        more = [] if found is None else ["_of", "_n", "_rest"]
        counts = some.groupBy(*group, *more, prefix).agg(F.count(F.lit(1)).alias("_c"))
        found = _found(counts, within, turn, probs)
        if turn == 0:
            found, few = sized(found, "ranks")
        else:
            found = found.drop("_of")
    values = found.select(*group, "_n", from_ordered_bits(F.col("_p")).alias("_value"), F.explode("_rest.rank").alias("_rank"))
    at = values.groupBy(*group).agg(
        F.max("_n").alias("n"), F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_at")
    )
    q = []
    for lo, hi, part in _ranks(probs, F.col("n")):
        low, high = F.element_at("_at", lo), F.element_at("_at", hi)
        q.append(F.when(part > 0, low + (high - low) * part).otherwise(low))
    return at.select(*[F.col(n).alias(k) for k, n in zip(by, names, strict=True)], "_col", "n", F.array(*q).alias("q"))


def exact_quantiles(df: DataFrame, by: Sequence[str], col: str, probs: Sequence[float]) -> DataFrame:
    """(by, n, q): quantiles of `col` per group, nulls and NaN skipped."""
    return exact_ranks(df, by, [col], probs).drop("_col")
