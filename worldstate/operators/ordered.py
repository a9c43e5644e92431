"""Order-dependent operators over keys of any size.

A plain window puts all rows of a key into one task. Here keys holding more than
``rows_per_task`` rows are first cut into consecutive ranges of the whole order ("segments"), by
sampled ranks, so outliers, crowded times and equal beginnings of texts are cut like all else. Each
window runs per (key, segment); what a segment needs to know about earlier (or later) rows is a
one-row summary per segment, combined across the segments of a key and joined back. Results equal
those of the plain window. Rows whose whole order is equal stay together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worldstate.session import cut_lineage

ROWS_PER_TASK = 2_000_000

SEG = "_segment"
PARTS = "_segments"


def order_value(df: DataFrame, name: str) -> Column:
    """A time or number as a DOUBLE that never decreases when the column grows; times in microseconds."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        micros = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{name}`)")
        return micros.cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(name)).cast("double")
    return F.col(name).cast("double")


def with_segments(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame | None:
    """``df`` with ``_segment`` and ``_segments`` (2 for keys that are split, else 1); None when none is.

    Rows of all large keys are range partitioned by key and order and written once, so segments
    can't shift and later steps read files. Segments hold about ``rows_per_task`` rows each. Rows with
    a null key are never split.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = cut_lineage(sizes.filter(F.col("_n") > rows_per_task), "hot-keys")
    total = hot.agg(F.sum("_n")).first()[0]
    if not total:
        return None
    marked = df.join(hot.select(*keys, F.lit(2).cast("bigint").alias(PARTS)), list(keys), "left")
    ranges = marked.filter(F.col(PARTS).isNotNull()).repartitionByRange(-(-total // rows_per_task), *keys, *order)
    cut = cut_lineage(ranges.withColumn(SEG, F.spark_partition_id().cast("bigint")), "segments")
    rest = marked.filter(F.col(PARTS).isNull()).withColumns({SEG: F.lit(0).cast("bigint"), PARTS: F.lit(1).cast("bigint")})
    return cut.unionByName(rest).select(*df.columns, SEG, PARTS)


class Ordered:
    """Rows of each key in a total order; methods add columns, ``result()`` ends the chain.

    All methods share one partitioning, so a chain costs one shuffle of the rows; with split keys
    each step adds a pass over the written segments for its summaries.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        rows_per_task: int = ROWS_PER_TASK,
    ):
        self._columns = list(df.columns)
        if not keys:
            df = df.withColumn("_all", F.lit(0))
        self.keys = list(keys) or ["_all"]
        self.order = list(order)
        segmented = with_segments(df, self.keys, self.order, rows_per_task)
        self._split = segmented is not None
        self.df = segmented if self._split else df
        group = [*self.keys, SEG] if self._split else self.keys
        self._window = Window.partitionBy(*group).orderBy(*self.order)
        self._backwards = Window.partitionBy(*group).orderBy(*[F.desc(c) for c in self.order])
        self._across = Window.partitionBy(*self.keys).orderBy(SEG)
        self._across_back = Window.partitionBy(*self.keys).orderBy(F.desc(SEG))

    def _add(self, name: str, value: Column, summary: Column, across: Column, merge) -> Ordered:
        """``merge(value within the segment, what the other segments contribute)``."""
        if name not in self._columns:
            self._columns.append(name)
        if not self._split:
            self.df = self.df.withColumn(name, value)
            return self
        carried = (
            self.df.filter(F.col(PARTS) > 1)
            .groupBy(*self.keys, SEG)
            .agg(summary.alias("_s"))
            .select(*self.keys, SEG, across.alias("_carry"))
        )
        self.df = (
            self.df.withColumn(name, value)
            .join(F.broadcast(carried), [*self.keys, SEG], "left")
            .withColumn(name, merge(F.col(name), F.col("_carry")))
            .drop("_carry")
        )
        return self

    def _position(self) -> Column:
        return F.struct(*self.order)

    def lag(self, name: str, value: Column) -> Ordered:
        """``value`` of the row before; a struct keeps several columns together."""
        return self._add(
            name,
            F.lag(value).over(self._window),
            F.max_by(value, self._position()),
            F.lag("_s").over(self._across),
            F.coalesce,
        )

    def lead(self, name: str, value: Column) -> Ordered:
        """``value`` of the row after."""
        return self._add(
            name,
            F.lead(value).over(self._window),
            F.min_by(value, self._position()),
            F.lead("_s").over(self._across),
            F.coalesce,
        )

    def last_known(self, name: str, value: Column) -> Ordered:
        """Latest non-null ``value`` up to and including the row."""
        known = F.when(value.isNotNull(), self._position())
        return self._add(
            name,
            F.last(value, ignorenulls=True).over(self._window.rowsBetween(Window.unboundedPreceding, 0)),
            F.max_by(value, known),
            F.last("_s", ignorenulls=True).over(self._across.rowsBetween(Window.unboundedPreceding, -1)),
            F.coalesce,
        )

    def next_known(self, name: str, value: Column) -> Ordered:
        """First non-null ``value`` of the rows after this one."""
        known = F.when(value.isNotNull(), self._position())
        return self._add(
            name,
            F.last(value, ignorenulls=True).over(self._backwards.rowsBetween(Window.unboundedPreceding, -1)),
            F.min_by(value, known),
            F.last("_s", ignorenulls=True).over(self._across_back.rowsBetween(Window.unboundedPreceding, -1)),
            F.coalesce,
        )

    def running_sum(self, name: str, value: Column) -> Ordered:
        """Sum of ``value`` up to and including the row."""
        return self._add(
            name,
            F.sum(value).over(self._window.rowsBetween(Window.unboundedPreceding, 0)),
            F.sum(value),
            F.sum("_s").over(self._across.rowsBetween(Window.unboundedPreceding, -1)),
            lambda here, before: here + F.coalesce(before, F.lit(0)),
        )

    def running_max(self, name: str, value: Column) -> Ordered:
        """Largest ``value`` up to and including the row."""
        return self._add(
            name,
            F.max(value).over(self._window.rowsBetween(Window.unboundedPreceding, 0)),
            F.max(value),
            F.max("_s").over(self._across.rowsBetween(Window.unboundedPreceding, -1)),
            F.greatest,
        )

    def row_number(self, name: str) -> Ordered:
        return self.running_sum(name, F.lit(1).cast("bigint"))

    def result(self, *columns: str | Column) -> DataFrame:
        if columns:
            return self.df.select(*columns)
        return self.df.select(*self._columns)


def number_in_order(df: DataFrame, order: Sequence[str], name: str = "place") -> DataFrame:
    """Rows numbered from 1 in a total order of the whole table.

    A range sort spreads the rows; each sorted task numbers its own, and the rows before a task
    are a prefix sum over tasks. The sorted rows are written once, so numbers cannot shift.
    """
    placed = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = cut_lineage(placed, "sorted").withColumn("_task", F.shiftright("_id", 33))
    sizes = placed.groupBy("_task").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_task", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    numbered = placed.join(starts, "_task")
    return numbered.select(*df.columns, (F.col("_id") + F.col("_shift")).alias(name))


def last_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of every key.

    Spark keeps one row per key and task before the shuffle (a rank limit of 1), so a hot key
    costs one row per task; unused columns are pruned at the scan.
    """
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_newest", F.row_number().over(newest)).filter(F.col("_newest") == 1).drop("_newest")
