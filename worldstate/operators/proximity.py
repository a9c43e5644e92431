"""Distance joins: bodies near points, any point near a shape, containing fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worldstate.functions.vectors import vec, vec_direction, vec_distance, vec_distance_sq
from worldstate.operators.boxes import point_box_pairs
from worldstate.session import cut_lineage

# fixed values: shapes nearer than the first distance are disabled, those beyond the second removed
DISABLE_WITHIN, REMOVE_BEYOND = 400.0, 1000.0

TASKS_PER_CORE = 4
FEW_POINTS = 4096  # point sets up to this size are broadcast (27 rows each)

def _centre() -> tuple[Column, Column, Column]:
    return F.col("cx"), F.col("cy"), F.col("cz")


def entities_near(points: DataFrame, bodies: DataFrame, key: Sequence[str], extra: float) -> DataFrame:
    """Pairs of points and bodies closer than body radius + ``extra``.

    ``bodies``: id, cx, cy, cz, radius. Result: key, x, y, z, body_id, centre, radius, distance.
    """
    reach = F.col("radius") + extra
    sides = bodies.select(F.col("id").alias("body_id"), "cx", "cy", "cz", "radius")
    centre = _centre()
    pairs = point_box_pairs(
        points.select(*key, "x", "y", "z"),
        sides,
        vec(),
        [c - reach for c in centre],
        [c + reach for c in centre],
        vec_distance(vec(), centre) < reach,
        finer=2,
        tasks=TASKS_PER_CORE * points.sparkSession.sparkContext.defaultParallelism,
    )
    return pairs.withColumn("distance", vec_distance(vec(), centre))


def containing_field(points: DataFrame, fields: DataFrame, key: Sequence[str]) -> DataFrame:
    """Adds ``field_id``, ``weightless`` and up_x, up_y, up_z (away from the field's centre).

    A field reaches over its radius plus atmosphere. Of several fields the nearest centre wins;
    in none the point is weightless and has no up. Places are searched once, however many points lie there.
    """
    place = ["x", "y", "z"]
    reaching = fields.withColumn("radius", F.col("radius") + F.col("atmosphere"))
    # of one centre, a field counts only if it reaches farther than all of smaller id
    before = Window.partitionBy("cx", "cy", "cz").orderBy("id", F.desc("radius")).rowsBetween(Window.unboundedPreceding, -1)
    reaching = reaching.withColumn("_before", F.max("radius").over(before)).filter("_before is null or radius > _before").drop("_before")
    inside = entities_near(points.select(*place).distinct(), reaching, [], 0.0)
    rank = F.struct("distance", "body_id")
    picked = inside.groupBy(*place).agg(F.min_by(F.struct("body_id", "cx", "cy", "cz"), rank).alias("_f"))
    out = points.join(picked, place, "left").select(*points.columns, "_f")
    up = vec_direction((F.col("_f.cx"), F.col("_f.cy"), F.col("_f.cz")), vec())
    return out.select(
        *points.columns,
        F.col("_f.body_id").alias("field_id"),
        F.col("_f").isNull().alias("weightless"),
        *[u.alias(f"up_{n}") for u, n in zip(up, "xyz")],
    )


def _summaries(points: DataFrame, cells: Sequence[str]) -> DataFrame:
    """Per occupied cell: the box around its points, and one of them."""
    return points.groupBy(*cells).agg(
        *[F.min(f"p{a}").alias(f"lo_{a}") for a in "xyz"],
        *[F.max(f"p{a}").alias(f"hi_{a}") for a in "xyz"],
        F.min(F.struct("px", "py", "pz")).alias("one"),
    )


def _verdict(distance: float) -> tuple[Column, Column]:
    """(certainly near, possibly near) of a shape and a cell summary.

    The margin keeps cell tests on the safe side of rounding; doubtful cells are settled exactly.
    """
    nearest, farthest = F.lit(0.0), F.lit(0.0)
    for a in "xyz":
        here, lo, hi = F.col(a), F.col(f"lo_{a}"), F.col(f"hi_{a}")
        gap = F.greatest(lo - here, here - hi, F.lit(0.0))
        far = F.greatest(F.abs(here - lo), F.abs(here - hi))
        nearest, farthest = nearest + gap * gap, farthest + far * far
    limit = distance * distance
    one = vec_distance_sq(vec(), (F.col("one.px"), F.col("one.py"), F.col("one.pz")))
    certain = (farthest < limit * (1 - 1e-9)) | (one < limit * (1 - 1e-9))
    return certain, nearest <= limit * (1 + 1e-9)


def _around(df: DataFrame, cells: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Each row once per neighbouring cell (27), under new column names."""
    for c, n in zip(cells, names):
        df = df.withColumn(n, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    return df


def near_any(
    shapes: DataFrame,
    points: DataFrame,
    distance: float,
    key: Sequence[str],
    inclusive: bool = False,
    few_points: int = FEW_POINTS,
) -> DataFrame:
    """Semi join: shapes with any point at squared distance < distance² (<= when ``inclusive``).

    At most ``few_points`` distinct points (checked: one more is looked at) are broadcast under
    their 27 neighbouring cells; shapes then need no shuffle at all. More points are reduced to one
    summary per grid cell, and each distinct place of a shape is compared once, however many shapes lie there:
    first with its own cell of half the distance, all of which is near, so crowded regions end there; then with the
    cells around. Only places still in doubt look at finer cells, and only the doubtful fine cells at single
    points, in a semi join that ends at the first point near enough and gives no row per pair. The rows are the
    same by either way. ``key`` names the shapes for the caller; shapes are met by place.
    """
    edge = distance * (1 + 1e-6)  # a little more than the distance, so that neighbours cover it
    spots = points.select(*[F.col(a).alias(f"p{a}") for a in "xyz"]).distinct()
    few = points.limit(few_points + 1).count() <= few_points
    if not few:
        spots = cut_lineage(spots, "spots")  # read up to five times below
        few = spots.limit(few_points + 1).count() <= few_points

    def cells(letter: str, axes: Sequence[str], width: float) -> dict[str, Column]:
        return {f"{letter}{a[-1]}": F.floor(F.col(a) / width) for a in axes}

    at, place = ["px", "py", "pz"], ["x", "y", "z"]
    coarse, fine, half = cells("g", at, edge), cells("f", at, edge / 8), cells("h", at, edge / 2)
    spots = spots.withColumns({**coarse, **fine, **half})
    g, f, h, own = list(coarse), list(fine), list(half), ["_gx", "_gy", "_gz"]
    owned = cells("_g", place, edge)
    gap = vec_distance_sq(vec(), (F.col("px"), F.col("py"), F.col("pz")))
    hit = gap <= distance * distance if inclusive else gap < distance * distance

    if few:
        spread = _around(spots.select(*at, *g), g, ["_nx", "_ny", "_nz"])
        same = [F.col(o) == F.col(n) for o, n in zip(own, ("_nx", "_ny", "_nz"))]
        return shapes.withColumns(owned).join(F.broadcast(spread), same[0] & same[1] & same[2] & hit, "left_semi").drop(*own)

    certain, possible = _verdict(distance)
    places = cut_lineage(shapes.select(*place).distinct(), "places")
    crowded = places.withColumns(cells("h", place, edge / 2)).join(_summaries(spots, h), h).filter(certain)
    near = cut_lineage(crowded.select(*place), "near")
    others = places.join(near, place, "left_anti").withColumns(owned)
    summaries = _around(_summaries(spots, g), g, own)
    first = others.join(summaries, own).filter(possible)
    doubtful = F.collect_list(F.when(~certain, F.struct(*g)))  # at most 27
    first = first.groupBy(*place).agg(F.max(certain).alias("_near"), doubtful.alias("_cells"))
    first = cut_lineage(first, "near")
    near = near.unionByName(first.filter("_near").select(*place))

    pending = first.filter(~F.col("_near"))
    if not pending.isEmpty():
        opened = pending.select(*place, F.inline("_cells"))
        second = opened.join(_summaries(spots, [*g, *f]), g).filter(possible)
        second = cut_lineage(second.select(*place, *f, certain.alias("_near")), "near")
        sure = second.filter("_near").select(*place).distinct()
        rest = second.filter(~F.col("_near")).join(sure, place, "left_anti")
        single = spots.select(*at, *[F.col(c).alias(f"_p{c}") for c in f])
        same = [F.col(c) == F.col(f"_p{c}") for c in f]
        rest = rest.join(single, same[0] & same[1] & same[2] & hit, "left_semi").select(*place)
        near = near.unionByName(sure).unionByName(rest.distinct())
    return shapes.join(near, place, "left_semi").select(*shapes.columns)


def retention_class(
    shapes: DataFrame,
    points: DataFrame,
    key: Sequence[str],
    disable_within: float = DISABLE_WITHIN,
    remove_beyond: float = REMOVE_BEYOND,
) -> DataFrame:
    """Adds ``retention``: disabled (a point is near), removed (none is even far), else kept.

    Settled per distinct place; only places with no point near are asked about the far distance.
    """
    place = ["x", "y", "z"]
    places = cut_lineage(shapes.select(*place).distinct(), "places")
    spots = cut_lineage(points.select(*place).distinct(), "spots")
    close = cut_lineage(near_any(places, spots, disable_within, place), "close")
    reach = near_any(places.join(close, place, "left_anti"), spots, remove_beyond, place)
    found = close.withColumn("retention", F.lit("disabled")).unionByName(reach.withColumn("retention", F.lit("kept")))
    retention = F.coalesce("retention", F.lit("removed")).alias("retention")
    return shapes.join(found, place, "left").select(*shapes.columns, retention)
