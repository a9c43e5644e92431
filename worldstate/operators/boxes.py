"""Point-in-box candidates by equality on grid cells, for box tables of any size.

Each box is laid on the grid whose cells are at least as large as the box, so it touches
at most two cells per axis. A point is looked up once per grid level in use. Axes on which
a box is (almost) unbounded are left out of its cell. The join is an equi join: Spark
broadcasts the boxes when they are small, shuffles and splits skewed cells when not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worldstate.session import cut_lineage

UNBOUNDED = 2.0**31
FINEST = -16  # smallest cell edge 2^-16
PAGE = 256  # boxes of one cell that a point carries
BROADCAST_BOXES = 50_000  # boxes, counted once per cell they touch, that are sent to all tasks

_CELL = ["_level", "_open", "_c0", "_c1", "_c2"]


def _cell(value: Column, edge: Column, is_open: Column) -> Column:
    return F.when(is_open, F.lit(0).cast("bigint")).otherwise(F.floor(value / edge))


def _lay_out(boxes: DataFrame, lows: Sequence[Column], highs: Sequence[Column], finer: int = 0) -> DataFrame:
    extents = [hi - lo for lo, hi in zip(lows, highs)]
    opens = [e >= UNBOUNDED for e in extents]
    closed = [F.when(~o, e) for o, e in zip(opens, extents)]
    largest = F.coalesce(F.greatest(*closed), F.lit(1.0))
    level = F.greatest(F.ceil(F.log2(F.greatest(largest, F.lit(2.0**FINEST)))) - finer, F.lit(FINEST)).cast("int")
    mask = sum((F.when(o, F.lit(1 << i)).otherwise(F.lit(0)) for i, o in enumerate(opens)), F.lit(0))
    out = boxes.withColumn("_level", level).withColumn("_open", mask)
    edge = F.pow(F.lit(2.0), F.col("_level"))
    for i, (lo, hi, o) in enumerate(zip(lows, highs, opens)):
        out = out.withColumn(f"_c{i}", F.explode(F.sequence(_cell(lo, edge, o), _cell(hi, edge, o))))
    return out


def point_box_pairs(
    points: DataFrame,
    boxes: DataFrame,
    at: Sequence[Column],
    lows: Sequence[Column],
    highs: Sequence[Column],
    condition: Column,
    on: Sequence[str] = (),
    finer: int = 0,
    tasks: int | None = None,
) -> DataFrame:
    """Inner join of points and boxes with ``condition``; every matching pair appears once.

    Cells are ``finer`` halvings smaller than the boxes, so a box lies in up to 2^finer + 1 per axis. Points are dealt by
    cell to ``tasks``, if given: a few of them may have very many pairs, which the size of their rows doesn't tell.
    ``condition`` must imply that the point lies within the closed box. ``on`` names extra
    columns both sides must share. Column names of the two sides must not overlap otherwise.
    """
    laid = _lay_out(boxes, lows, highs, finer)
    levels = laid.select("_level", "_open").distinct().agg(F.collect_set(F.struct("_level", "_open")).alias("v"))
    probes = points.withColumn("_lv", F.explode(levels.scalar())).select("*", "_lv.*").drop("_lv")
    edge = F.pow(F.lit(2.0), F.col("_level"))
    for i, value in enumerate(at):
        is_open = F.col("_open").bitwiseAND(1 << i) != 0
        probes = probes.withColumn(f"_c{i}", _cell(value, edge, is_open))
    if tasks is not None:
        probes = probes.repartition(tasks, *on, *_CELL)
    return probes.join(laid, [*on, *_CELL]).filter(condition).drop(*_CELL)


def first_box(
    points: DataFrame, boxes: DataFrame, key: Sequence[str], at: Sequence[Column], lows: Sequence[Column], highs: Sequence[Column], fits, page: int = PAGE
) -> DataFrame:
    """``points`` with ``_hit``: the first of the boxes (a struct, by its leading columns) that ``fits(box)``; else null.

    The boxes are grouped by cell first, so a point joins one list per grid level in use and stays one row where it
    is while the lists are small enough to broadcast (counted). A list holds the first ``page`` boxes of its cell. Where a cell has
    more, points that found none on its list meet the others by an equi join, and the first is a minimum per
    ``key`` (unique); so no list grows with the boxes. One small job on the boxes tells levels and longest lists.
    """
    item = F.struct(*[F.col(c) for c in boxes.columns])
    laid = _lay_out(boxes, lows, highs)
    sizes = laid.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("n")).groupBy("_level", "_open").agg(F.max("n"), F.sum("n"))
    levels = sorted(tuple(r) for r in sizes.collect())
    small = sum(total for *_, total in levels) <= BROADCAST_BOXES
    place = F.row_number().over(Window.partitionBy(*_CELL).orderBy(*boxes.columns))
    columns, found, unsure = list(points.columns), points, F.lit(False)
    hits = []
    for n, (level, open_axes, longest, _) in enumerate(levels):
        own = laid.filter((F.col("_level") == level) & (F.col("_open") == open_axes))
        if longest > page:
            own = own.withColumn("_place", place).filter(F.col("_place") <= page)
        names = [f"_at{n}_{i}" for i in range(3)]
        lists = own.groupBy("_c0", "_c1", "_c2").agg(F.collect_list(item).alias(f"_list{n}"))
        lists = lists.select(*[F.col(f"_c{i}").alias(name) for i, name in enumerate(names)], f"_list{n}")
        cells = {name: _cell(value, F.lit(2.0**level), F.lit(bool(open_axes & 1 << i))) for i, (name, value) in enumerate(zip(names, at))}
        found = found.withColumns(cells).join(F.broadcast(lists) if small else lists, names, "left").drop(*names)
        hit = F.array_min(F.filter(f"_list{n}", fits))
        hits.append(hit)
        if longest > page:
            unsure = unsure | F.coalesce((F.size(f"_list{n}") == page) & hit.isNull(), F.lit(False))
    kind = F.lit(None).cast(boxes.select(item.alias("b")).schema["b"].dataType)
    best = F.array_min(F.array(kind, *hits)) if hits else kind
    found = found.select(*columns, best.alias("_hit"), unsure.alias("_unsure"))
    if all(longest <= page for _, _, longest, _ in levels):
        return found.drop("_unsure")
    rest = laid.withColumn("_place", place).filter(F.col("_place") > page).select(item.alias("_box"), *_CELL)
    doubtful = cut_lineage(found.filter("_unsure").drop("_unsure"), "doubtful")
    probes = doubtful.withColumn("_lv", F.explode(F.array(*[F.struct(F.lit(a).alias("_level"), F.lit(b).alias("_open")) for a, b, *_ in levels]))).select("*", "_lv.*")
    edge = F.pow(F.lit(2.0), F.col("_level"))
    for i, value in enumerate(at):
        probes = probes.withColumn(f"_c{i}", _cell(value, edge, F.col("_open").bitwiseAND(1 << i) != 0))
    others = probes.join(rest, _CELL).filter(fits(F.col("_box"))).groupBy(*key).agg(F.min("_box").alias("_other"))
    settled = found.filter(~F.col("_unsure")).drop("_unsure")
    return settled.unionByName(doubtful.join(others, list(key), "left").withColumn("_hit", F.array_min(F.array("_hit", "_other"))).drop("_other"))
