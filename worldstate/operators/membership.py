"""Areas entered and left: intervals, and the innermost area at each event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worldstate.operators import ranges
from worldstate.operators.ordered import ROWS_PER_TASK, Ordered
from worldstate.session import cut_lineage


def membership_intervals(
    events: DataFrame,
    keys: Sequence[str] = ("entity_id", "area_id"),
    order: Sequence[str] = ("ts", "seq"),
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """``entered_at, left_at`` per stay; an open stay has no ``left_at``.

    Entering again while inside and leaving while outside change nothing.
    """
    left = F.when(F.col("kind") == "exit", F.col(order[0]))
    rows = (
        Ordered(events.select(*keys, *order, "kind"), keys, order, rows_per_task)
        .lag("_before", F.col("kind"))
        .next_known("left_at", left)
        .result()
    )
    entering = (F.col("kind") == "enter") & (F.coalesce("_before", F.lit("exit")) == "exit")
    return rows.filter(entering).select(*keys, F.col(order[0]).alias("entered_at"), "left_at", order[-1])


def current_parent(
    events: DataFrame,
    keys: Sequence[str] = ("entity_id",),
    order: Sequence[str] = ("ts", "seq"),
    area: str = "area_id",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Adds ``parent_area``: the area entered last and not yet left, after each event; else null.

    Stays are intervals between two events; those open where a range of events begins are the list that enters it, by
    the time of entering. So all ranges are worked on at once, each from its own list (the areas an entity is in).
    """
    placed = cut_lineage(ranges.numbered(events, keys, order, rows_per_task), "placed")
    left = F.when(F.col("kind") == "exit", F.col("_at"))
    stays = Ordered(placed.select(*keys, area, "_at", "kind"), [*keys, area], ["_at"], rows_per_task)
    stays = stays.lag("_before", F.col("kind")).next_known("_left", left).result()
    stays = stays.filter((F.col("kind") == "enter") & (F.coalesce("_before", F.lit("exit")) == "exit"))
    last = placed.groupBy(*keys).agg(F.max("_range").alias("_last"))
    first = F.expr(f"(_at - 1) div {ranges.RANGE} + 1")
    until = F.coalesce(F.expr(f"(_left - 1) div {ranges.RANGE}"), F.col("_last"))
    crossing = stays.join(last, list(keys)).withColumns({"_first": first, "_until": until}).filter("_first <= _until")
    crossing = crossing.select(*keys, "_at", area, F.explode(F.sequence("_first", "_until")).alias("_range"))
    entering = crossing.groupBy(*keys, "_range").agg(F.array_sort(F.collect_list(F.struct("_at", area))).alias("_open"))
    held = ranges.in_ranges(placed, keys).join(entering, [*keys, "_range"], "left")
    nothing = F.array().cast(f"array<{dict(events.dtypes)[area]}>")

    def step(inside: Column, row: Column) -> Column:
        where = row[area]
        there = F.array_contains(inside, where)
        entered = F.when(there, inside).otherwise(F.array_append(inside, where))
        return F.when(where.isNull(), inside).when(row["kind"] == "enter", entered).otherwise(F.array_remove(inside, where))

    opened = F.coalesce(F.transform("_open", lambda o: o[area]), nothing)
    inside = ranges.states(F.col("rows"), opened, step)
    parents = F.transform(inside, lambda areas: F.get(areas, F.size(areas) - 1))
    after = held.select(*keys, F.explode(F.arrays_zip("rows", parents.alias("parent_area"))).alias("r"))
    return after.select(*[F.col(c) if c in keys else F.col(f"r.rows.{c}").alias(c) for c in events.columns], "r.parent_area")
