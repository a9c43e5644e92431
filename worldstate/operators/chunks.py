"""Spatial chunk index: contents, focus, changes, uid handling, camera updates."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worldstate.functions.spatial import (
    CHUNK_SIZES,
    SIZE_THRESHOLDS,
    cell_of_position,
    chunk_position,
    size_category,
)
from worldstate.operators.folds import chained_fold
from worldstate.operators.ordered import ROWS_PER_TASK, Ordered
from worldstate.operators.proximity import TASKS_PER_CORE, entities_near
from worldstate.session import cut_lineage
from worldstate.streaming.folds import stream_fold

CHUNK_KEY = ["size_cat", "cx", "cz"]
CENTRES_PER_TASK = 64  # a centre's cells are many times its rows before they are widened


def with_chunk(
    df: DataFrame, thresholds: Sequence[float] = SIZE_THRESHOLDS, sizes: Sequence[float] = CHUNK_SIZES
) -> DataFrame:
    """Adds size_cat, cx, cz from size, x and z."""
    out = df.withColumn("size_cat", size_category(F.col("size"), thresholds))
    cx, cz = chunk_position(F.col("x"), F.col("z"), F.col("size_cat"), sizes)
    return out.withColumns({"cx": cx, "cz": cz})


def chunk_index(nodes: DataFrame, **kwargs) -> DataFrame:
    """Index rows (size_cat, cx, cz, uid), each once.

    One row per entry instead of one list per chunk: a crowded chunk, such as the single one
    of all HUGE nodes, then spreads over many tasks. Store it partitioned by size_cat.
    """
    return with_chunk(nodes, **kwargs).select(*CHUNK_KEY, "uid").distinct()


def chunk_contents(index: DataFrame, nodes: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Nodes of all (or the given) chunks with their chunk key."""
    if chunks is not None:
        index = index.join(chunks.select(*CHUNK_KEY).distinct(), CHUNK_KEY, "left_semi")
    return nodes.join(index, "uid")


def _centres(focus: DataFrame, key: Sequence[str], sizes: Sequence[float]) -> DataFrame:
    """Own chunk (_x, _z) of each focus point in every size class."""
    rows = focus.select(*key, "x", "z", F.explode(F.sequence(F.lit(0), F.lit(len(sizes)))).alias("size_cat"))
    cx, cz = chunk_position(F.col("x"), F.col("z"), F.col("size_cat"), sizes)
    return rows.select(*key, "size_cat", cx.alias("_x"), cz.alias("_z"))


def _square(centres: DataFrame, load_range: int, sizes: Sequence[float]) -> DataFrame:
    """The (2r+1)² chunks around each centre; HUGE has only its one chunk."""
    offsets = F.sequence(F.lit(-load_range), F.lit(load_range))
    around = F.when(F.col("size_cat") < len(sizes), offsets).otherwise(F.array(F.lit(0)))
    for n in "xz":
        centres = centres.withColumn("_d", F.explode(around)).withColumn(f"c{n}", F.col(f"_{n}") + F.col("_d"))
    return centres.drop("_d")


def focus_chunks(
    focus: DataFrame, key: Sequence[str], load_range: int = 3, sizes: Sequence[float] = CHUNK_SIZES
) -> DataFrame:
    """Chunks each focus point keeps loaded: (2r+1)² per size class, and the one HUGE chunk."""
    return _square(_centres(focus, key, sizes), load_range, sizes).select(*key, *CHUNK_KEY)


def focus_contents(
    focus: DataFrame, index: DataFrame, load_range: int = 3, sizes: Sequence[float] = CHUNK_SIZES
) -> DataFrame:
    """Index rows resident for any focus point.

    Focus points in one chunk need the same chunks: centres are made distinct before they are
    expanded, and the chunks again before the join.
    """
    centres = _centres(focus, [], sizes).distinct()
    needed = _square(centres, load_range, sizes).select(*CHUNK_KEY).distinct()
    return index.join(needed, CHUNK_KEY, "left_semi")


def focus_load(
    focus: DataFrame, index: DataFrame, key: Sequence[str], load_range: int = 3, sizes: Sequence[float] = CHUNK_SIZES
) -> DataFrame:
    """Number of nodes each focus point keeps loaded, per size class (classes without nodes left out).

    Nodes are counted per chunk and chunks summed per distinct centre, so the work per focus
    point is one lookup per class.
    """
    per_chunk = index.groupBy(*CHUNK_KEY).agg(F.count(F.lit(1)).alias("_n"))
    own = _centres(focus, key, sizes)
    place = ["size_cat", "_x", "_z"]
    around = _square(own.select(*place).distinct(), load_range, sizes)
    per_centre = around.join(per_chunk, CHUNK_KEY).groupBy(*place).agg(F.sum("_n").alias("nodes"))
    return own.join(per_centre, place).select(*key, "size_cat", "nodes")


def chunk_changes(needed: DataFrame, loaded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of either side with ``action``: load, unload or keep."""
    a = needed.select(*keys).distinct().withColumn("_need", F.lit(True))
    b = loaded.select(*keys).distinct().withColumn("_have", F.lit(True))
    action = F.when(F.col("_have").isNull(), "load").when(F.col("_need").isNull(), "unload").otherwise("keep")
    return a.join(b, list(keys), "full").select(*keys, action.alias("action"))


def moved_chunks(index: DataFrame, nodes: DataFrame, **kwargs) -> DataFrame:
    """Index entries whose chunk no longer fits the node, with the new chunk (``new_*``)."""
    now = with_chunk(nodes, **kwargs).select("uid", *[F.col(c).alias(f"new_{c}") for c in CHUNK_KEY])
    stale = F.lit(False)
    for c in CHUNK_KEY:
        stale = stale | (F.col(c) != F.col(f"new_{c}"))
    return index.join(now, "uid").filter(stale)


def _near_cells(
    spots: DataFrame, sides: Sequence[str], centres: DataFrame, radius: int, cell_size: float, spawn_distance: float
) -> DataFrame:
    """Per numbered centre (``_centre``) and cell: how near the nearest spot comes whose cell is within ``radius`` cells.

    One column per side, over the spots that are true there; null without any. Bodies of one centre share the
    search, and every cell is widened along one axis after the other, so no spot is expanded into a cube of cells.
    The widening is dealt by the number of centres, since the size of the rows before it doesn't tell of those after.
    """
    tasks = max(spots.sparkSession.sparkContext.defaultParallelism, math.ceil(centres.count() / CENTRES_PER_TASK))
    near = entities_near(spots, centres, sides, spawn_distance).withColumnRenamed("body_id", "_centre")
    cells = cell_of_position(*[F.col(a) - F.col(f"c{a}") for a in "xyz"], cell_size)
    named = [c.alias(f"c{a}") for c, a in zip(cells, "xyz")]
    found = near.select("_centre", *named, *[F.when(F.col(s), F.col("distance")).alias(s) for s in sides])
    nearest = [F.min(s).alias(s) for s in sides]
    found = found.groupBy("_centre", "cx", "cy", "cz").agg(*nearest).repartition(tasks, "_centre")
    for n in ("cx", "cy", "cz"):
        around = F.explode(F.array(*[F.col(n) + d for d in range(-radius, radius + 1)]))
        found = found.withColumn(n, around).groupBy("_centre", "cx", "cy", "cz").agg(*nearest)
    return found


def _cells_of_centres(
    spots: DataFrame, sides: Sequence[str], bodies: DataFrame, radius: int, cell_size: float, spawn_distance: float
) -> tuple[DataFrame, DataFrame]:
    """``_near_cells`` of the distinct centres, and the bodies (body_id, radius) by the number of their centre."""
    place = ["cx", "cy", "cz"]
    centres = bodies.groupBy(*place).agg(F.max("radius").alias("radius"))
    centres = cut_lineage(centres.withColumn("id", F.monotonically_increasing_id()), "centres")
    own = bodies.select(F.col("id").alias("body_id"), *place, "radius").join(centres.select(*place, F.col("id").alias("_centre")), place).drop(*place)
    return _near_cells(spots, sides, centres, radius, cell_size, spawn_distance), own


def _taken(found: DataFrame, own: DataFrame, sides: Sequence[str], bodies: DataFrame, spawn_distance: float) -> DataFrame:
    """Cells of every body (body_id, cx, cy, cz), with the sides that reach it as booleans."""
    place = ["cx", "cy", "cz"]
    once = bodies.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    reached = [F.coalesce(F.col(s) < F.col("radius") + spawn_distance, F.lit(False)).alias(s) for s in sides]
    out = found.join(own.hint("shuffle_hash"), "_centre").select("body_id", *place, *reached)
    out = out.filter(" or ".join(f"`{s}`" for s in sides))
    return out if once else out.groupBy("body_id", *place).agg(*[F.max(s).alias(s) for s in sides])


def _cells_of_bodies(spots: DataFrame, sides: Sequence[str], bodies: DataFrame, radius: int, cell_size: float, spawn_distance: float) -> DataFrame:
    found, own = _cells_of_centres(spots, sides, bodies, radius, cell_size, spawn_distance)
    return _taken(found, own, sides, bodies, spawn_distance)


def needed_cells(
    points: DataFrame,
    bodies: DataFrame,
    key: Sequence[str],
    radius: int = 1,
    cell_size: float = 300.0,
    spawn_distance: float = 1200.0,
) -> DataFrame:
    """Cells (body_id, cx, cy, cz) around every point near a body, relative to its centre.

    Points at one place and bodies with one centre are searched once; a body takes those cells of its centre
    that have a point within its own reach.
    """
    spots = points.select("x", "y", "z").distinct().withColumn("_need", F.lit(True))
    return _cells_of_bodies(spots, ["_need"], bodies, radius, cell_size, spawn_distance).drop("_need")


def needed_cells_and_places(
    points: DataFrame, bodies: DataFrame, radius: int = 1, cell_size: float = 300.0, spawn_distance: float = 1200.0
) -> tuple[DataFrame, DataFrame]:
    """``needed_cells``, and the distinct cells (cx, cy, cz) among them.

    What both come from, the cells of each distinct centre, is written once. The cells of all bodies are many times as
    many: they are neither written nor shuffled, but made where they are used, dealt by centre to all cores.
    """
    spots = points.select("x", "y", "z").distinct().withColumn("_need", F.lit(True))
    found, own = _cells_of_centres(spots, ["_need"], bodies, radius, cell_size, spawn_distance)
    found = cut_lineage(found, "cells")
    tasks = TASKS_PER_CORE * points.sparkSession.sparkContext.defaultParallelism
    cells = _taken(found.repartition(tasks, "_centre"), own, ["_need"], bodies, spawn_distance).drop("_need")
    return cells, found.select("cx", "cy", "cz").distinct()


def needed_changes(
    points: DataFrame, before: DataFrame, bodies: DataFrame, radius: int = 1, cell_size: float = 300.0, spawn_distance: float = 1200.0
) -> DataFrame:
    """``chunk_changes`` between the needed cells of ``points`` and of ``before``, in one search for both.

    The sides are compared per centre, before its bodies take their cells, so no cell of a body is shuffled.
    """
    both = points.select("x", "y", "z", F.lit(True).alias("_need"), F.lit(False).alias("_have")).unionByName(
        before.select("x", "y", "z", F.lit(False).alias("_need"), F.lit(True).alias("_have"))
    )
    sides = ["_need", "_have"]
    spots = both.groupBy("x", "y", "z").agg(*[F.max(s).alias(s) for s in sides])
    cells = _cells_of_bodies(spots, sides, bodies, radius, cell_size, spawn_distance)
    action = F.when(~F.col("_have"), "load").when(~F.col("_need"), "unload").otherwise("keep")
    return cells.select("body_id", "cx", "cy", "cz", action.alias("action"))


def find_nodes(nodes: DataFrame, uid: str) -> DataFrame:
    """Exact uid, else every node whose uid ends with it."""
    exact = nodes.filter(F.col("uid") == uid).withColumn("exact", F.lit(True))
    suffix = nodes.filter(F.endswith(F.col("uid"), F.lit(uid))).withColumn("exact", F.col("uid") == uid)
    return suffix if exact.isEmpty() else exact


def dedupe_uids(nodes: DataFrame, order: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Later nodes of a repeated uid get ``<name before the dash>-<uid rank hash>``.

    The new suffix is derived from uid and rank, so a repeated task assigns the same one.
    """
    ranked = Ordered(nodes, ["uid"], order, rows_per_task).row_number("_rank").result()
    stem = F.element_at(F.split("uid", "-"), 1)
    suffix = F.substring(F.md5(F.concat_ws("#", F.col("uid"), F.col("_rank").cast("string"))), 1, 16)
    return ranked.withColumn("uid", F.when(F.col("_rank") > 1, F.concat(stem, F.lit("-"), suffix)).otherwise(F.col("uid"))).drop("_rank")


def camera_step(step: float):
    def run(last, rows):
        x0, y0, z0 = last if last is not None else (0.0, 0.0, 0.0)
        updated = np.zeros(len(rows), dtype=bool)
        for i, (x, y, z) in enumerate(zip(rows["x"].tolist(), rows["y"].tolist(), rows["z"].tolist())):
            if math.sqrt((x - x0) * (x - x0) + (y - y0) * (y - y0) + (z - z0) * (z - z0)) >= step:
                updated[i] = True
                x0, y0, z0 = x, y, z
        return [x0, y0, z0], {"updated": updated}

    return run


def camera_updates(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    step: float = CHUNK_SIZES[0] * 0.1,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Rows at least ``step`` away from the last *updated* place of their key; the first from zero.

    Works on a stream or a table.
    """
    rows = df.select(*keys, *order, "x", "y", "z")
    if df.isStreaming:
        marked = stream_fold(rows, keys, order, camera_step(step), "updated boolean")
    else:
        marked = chained_fold(rows, keys, order, camera_step(step), "updated boolean", rows_per_task)
    return marked.filter("updated").drop("updated")
