"""Ordered operators over series of any length, as a segmented scan on two levels.

A window partitioned by the series key puts a whole series in one task, which fails when
one series holds a large share of all rows. Here a series is cut along its order column
into fixed slices (of time, or of the number it is ordered by), so rows are dealt by
(series, slice) without looking at the data first:

* on the first level windows run per (series, slice);
* the last row of a slice, with what its window has found, is the slice's edge row; on the
  second level windows run over a series' edge rows, of which there is one per slice, and
  give every slice what it needs from the slices before it (its carry).

Rows and edge rows come from one shuffle: rows travel packed, so that both levels read the
same columns and Spark runs the exchange once, however many steps follow each other. Nothing
runs until the result is read. Rows with an identical order value stay in one slice.

`spark.tidewatch.sliceSeconds` and `spark.tidewatch.sliceNumbers` set the width of a slice:
narrow enough for a slice of the densest series to fit a task, wide enough for the slices
of the longest one to.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_SECONDS = 3600.0
SLICE_NUMBERS = 1_000_000.0


def _slice(df: DataFrame, order: Sequence[str], width: float | None) -> Column:
    """The slice of a row: what comes before the first time or number in the order, and how
    many widths that time or number holds."""
    conf, labels = df.sparkSession.conf, []
    for name in order:
        kind = df.schema[name].dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            seconds = width or float(conf.get("spark.tidewatch.sliceSeconds", str(SLICE_SECONDS)))
            number = F.floor(F.unix_micros(F.col(name).cast("timestamp")) / F.lit(seconds * 1e6))
        elif isinstance(kind, T.NumericType):
            numbers = width or float(conf.get("spark.tidewatch.sliceNumbers", str(SLICE_NUMBERS)))
            number = F.col(name).cast("double")
            # NaN comes after all numbers
            number = F.when(F.isnan(number), F.lit((1 << 63) - 1)).otherwise(F.floor(number / F.lit(numbers)))
        else:
            labels.append(name)
            continue
        return F.struct(*labels, number.alias("_n"))
    raise TypeError(f"the order needs a time or a number: {list(order)}")


class Ordered:
    """Rows of every series in order, in slices that fit a task."""

    def __init__(self, df: DataFrame, by: Sequence[str], order: Sequence[str], width: float | None = None):
        self.order = list(order)
        key = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))
        # a struct is never null, so series with a missing label join like any other; the
        # array keeps the optimizer from reading other columns for the edge rows
        packed = df.select(key.alias("_key"), _slice(df, order, width).alias("_slice"), F.array(F.struct(*df.columns)).alias("_row"))
        packed = packed.repartition("_key", "_slice")
        self.rows = packed.select("_key", "_slice", *[F.element_at("_row", 1)[c].alias(c) for c in df.columns])

    def _same(self, rows: DataFrame) -> Ordered:
        other = Ordered.__new__(Ordered)
        other.order, other.rows = self.order, rows
        return other

    def then(self, change: Callable[[DataFrame], DataFrame]) -> Ordered:
        """Add columns or drop rows between two ordered steps; keeps the slices."""
        return self._same(change(self.rows))

    def result(self) -> DataFrame:
        return self.rows.drop("_key", "_slice")

    def _within(self, reverse: bool = False) -> Window:
        order = [F.col(c).desc() if reverse else F.col(c).asc() for c in self.order]
        return Window.partitionBy("_key", "_slice").orderBy(*order)

    def _with_carry(self, rows: DataFrame, edge: Column, carry: Callable[[Window], Column], reverse: bool = False) -> DataFrame:
        """Adds `_carry`: `carry` over the `_e` of the slices before; `edge` makes a slice's
        `_e` of `_last`, its last row by `_rn`."""
        last = rows.groupBy("_key", "_slice").agg(F.max_by(F.struct(*rows.columns), "_rn").alias("_last"))
        over = Window.partitionBy("_key").orderBy(F.col("_slice").desc() if reverse else F.col("_slice").asc())
        edges = last.select("_key", "_slice", edge.alias("_e")).select("_key", "_slice", carry(over).alias("_carry"))
        return rows.join(edges, ["_key", "_slice"])

    def lag(self, cols: Sequence[str], n: int = 1) -> Ordered:
        """Add `_prev1` .. `_prev<n>`: structs of `cols` of the n preceding rows."""
        row, within = F.struct(*cols), self._within()
        local = {f"_prev{i}": F.lag(row, i).over(within) for i in range(1, n + 1)}
        rows = self.rows.withColumns({"_rn": F.row_number().over(within), **local})
        # the last n rows of a slice, latest first; a slice has one at least
        latest = F.array(F.struct(*[F.col("_last")[c].alias(c) for c in cols]), *[F.col("_last")[f"_prev{i}"] for i in range(1, n)])
        rows = self._with_carry(
            rows,
            F.filter(latest, lambda x: x.isNotNull()),
            lambda over: F.concat(*[F.coalesce(F.lag("_e", i).over(over), F.array()) for i in range(1, n + 1)]),
        )
        found = {
            f"_prev{i}": F.when(F.col("_rn") > i, F.col(f"_prev{i}")).otherwise(F.get("_carry", F.lit(i) - F.col("_rn")))
            for i in range(1, n + 1)
        }
        return self._same(rows.withColumns(found).drop("_rn", "_carry"))

    def running_sum(self, value: Column, name: str) -> Ordered:
        """Sum from the start of the series up to and including the row."""
        within = self._within()
        up_to = within.rowsBetween(Window.unboundedPreceding, 0)
        rows = self.rows.withColumns({"_rn": F.row_number().over(within), name: F.sum(value).over(up_to)})
        before = (Window.unboundedPreceding, -1)
        rows = self._with_carry(rows, F.col("_last")[name], lambda over: F.sum("_e").over(over.rowsBetween(*before)))
        total = F.when(F.col("_carry").isNull(), F.col(name)).otherwise(F.coalesce(F.col(name), F.lit(0)) + F.col("_carry"))
        return self._same(rows.withColumn(name, total).drop("_rn", "_carry"))

    def nearest_known(self, value: Column, name: str, *, after: bool = False) -> Ordered:
        """Nearest non-null `value` strictly before the row, or strictly after it."""
        within = self._within(reverse=after)
        earlier = within.rowsBetween(Window.unboundedPreceding, -1)
        so_far = within.rowsBetween(Window.unboundedPreceding, 0)
        known = lambda over: F.last("_x", ignorenulls=True).over(over)
        rows = self.rows.withColumn("_x", value)
        rows = rows.withColumns({"_rn": F.row_number().over(within), name: known(earlier), "_seen": known(so_far)})
        before = (Window.unboundedPreceding, -1)
        rows = self._with_carry(
            rows, F.col("_last")["_seen"], lambda over: F.last("_e", ignorenulls=True).over(over.rowsBetween(*before)), after
        )
        return self._same(rows.withColumn(name, F.coalesce(name, "_carry")).drop("_x", "_rn", "_seen", "_carry"))
