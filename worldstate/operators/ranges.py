"""Folds by parallel prefix: rows in numbered ranges, what enters each range found without walking the ones before.

A key's rows are numbered in order and cut into ranges of ``RANGE`` rows. Each range is one array, folded inside
the JVM from the state that enters it. Where the state is one of few values, a range is a map from values to values;
maps compose, ``FAN`` at a time, so the states entering all ranges are known after a number of steps that grows with
the logarithm of the longest key, and no range is ever run twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worldstate.operators.ordered import ROWS_PER_TASK, Ordered
from worldstate.session import cut_lineage

RANGE = 256
FAN = 256


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Adds ``_at`` (from 1 per key) and ``_range``."""
    placed = Ordered(df, keys, order, rows_per_task).row_number("_at").result()
    return placed.withColumn("_range", F.expr(f"(_at - 1) div {RANGE}"))


def in_ranges(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per range: its rows as ``rows``, an array in order."""
    fields = ["_at", *[c for c in df.columns if c not in (*keys, "_at", "_range")]]
    return df.groupBy(*keys, "_range").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))


def states(rows: Column, entering: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The state after each element of ``rows``; ``step(state, element)`` gives the next."""
    kept = F.array_append
    start = F.array(entering)
    return F.slice(F.aggregate(rows, start, lambda held, row: kept(held, step(F.element_at(held, -1), row))), F.lit(2), F.size(rows))


def entering_values(
    ranges: DataFrame, keys: Sequence[str], values: Sequence[int], start: int, step: Callable[[Column, Column], Column]
) -> DataFrame:
    """``keys, _range, entering``: the value that enters each range of keys with several ranges, ``start`` the first.

    ``values`` are all a state can be; ``step(value, row)`` stays among them.
    """
    index = {v: i for i, v in enumerate(values)}
    domain = F.array(*[F.lit(v) for v in values])
    final = F.transform(domain, lambda v: F.array_position(domain, F.aggregate("rows", v, step)).cast("int") - 1)
    last = ranges.groupBy(*keys).agg(F.max("_range").alias("_last")).filter("_last > 0")
    level = ranges.join(last, list(keys)).select(*keys, F.col("_range").alias("_n"), final.alias("map"))
    levels = [cut_lineage(level, "maps")]
    most = levels[0].agg(F.coalesce(F.max("_n"), F.lit(0))).first()[0]
    while most > 0:  # maps of groups of ranges, then of groups of groups
        most //= FAN
        groups = levels[-1].groupBy(*keys, F.expr(f"_n div {FAN}").alias("_group")).agg(F.array_sort(F.collect_list(F.struct("_n", "map"))).alias("maps"))
        identity = F.sequence(F.lit(0), F.lit(len(values) - 1))
        whole = F.aggregate("maps", identity, lambda held, m: F.transform(held, lambda i: F.get(m["map"], i)))
        levels.append(cut_lineage(groups.select(*keys, F.col("_group").alias("_n"), "maps", whole.alias("map")), "maps"))
    entering = levels[-1].select(*keys, "_n", F.lit(index[start]).alias("i"))
    for level in reversed(levels[1:]):
        held = level.select(*keys, "_n", "maps").join(entering, [*keys, "_n"])
        before = F.slice(states(F.col("maps"), F.col("i"), lambda i, m: F.get(m["map"], i)), F.lit(1), F.size("maps") - 1)
        parts = F.arrays_zip(F.transform("maps", lambda m: m["_n"]).alias("_n"), F.concat(F.array("i"), before).alias("i"))
        entering = cut_lineage(held.select(*keys, F.explode(parts).alias("p")).select(*keys, "p._n", "p.i"), "entering")
    return entering.select(*keys, F.col("_n").alias("_range"), F.element_at(domain, F.col("i") + 1).alias("entering"))
