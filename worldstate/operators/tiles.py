"""Planet tiles: quadtree by distance, asset scatter, tile changes."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worldstate.functions.spatial import cell_seed
from worldstate.functions.terrain import FACES, hash_draw, terrain_elevation, with_unit_direction
from worldstate.functions.vectors import Vec, vec_normalize
from worldstate.operators.chunks import chunk_changes
from worldstate.operators.proximity import near_any
from worldstate.session import cut_lineage

# fixed values of the quadtree
MAX_DEPTH = 8
SPLIT_FACTOR = 0.7
# fixed values: assets per cell, share of the cell they spread over
MIN_ASSETS, MAX_ASSETS, JITTER = 3, 10, 0.5
FEW_LISTS = 100_000  # asset lists, at most ten assets each, that are sent to all tasks

Noise = Callable[[Vec], Mapping[str, Column]]


def quadtree_tiles(
    spark: SparkSession, focus: DataFrame, radius: float, max_depth: int = MAX_DEPTH, base_height: float = 0.0
) -> DataFrame:
    """Tiles of the six faces: face, path, depth, u, v (lower corner), size, is_leaf, is_collision.

    A tile's children are split while the tile's depth is below ``max_depth`` and some focus point is
    within radius × tile size × 0.7 of the child centre's surface point. Every node of depth
    ``max_depth`` also gives a collision tile. One round per depth; tiles stay on the executors.
    """
    roots = [(face, "Chunk_0", 0.0, 0.0) for face in range(len(FACES))]
    parents = spark.createDataFrame(roots, "face int, path string, cu double, cv double")
    focus = cut_lineage(focus.select("x", "y", "z").distinct(), "focus")
    found = None
    for depth in range(max_depth + 1):
        size = 2.0 / 2**depth
        number = F.explode(F.sequence(F.lit(0), F.lit(3)))
        children = parents.select("face", F.col("path").alias("_up"), "cu", "cv", number.alias("_i")).select(
            "face",
            F.concat_ws("_", "_up", F.col("_i").cast("string")).alias("path"),
            (F.col("cu") + (F.col("_i") % 2 * 2 - 1) * (size / 4)).alias("cu"),
            (F.col("cv") + (F.floor(F.col("_i") / 2) * 2 - 1) * (size / 4)).alias("cv"),
        )
        if depth < max_depth:
            placed = with_unit_direction(children, F.col("face"), F.col("cu"), F.col("cv"), "xyz")
            placed = placed.withColumns({a: F.col(a) * (radius + base_height) for a in "xyz"})
            reach = radius * size * SPLIT_FACTOR
            split = near_any(placed, focus, reach, ["face", "path"], inclusive=True).select(*children.columns)
            split = cut_lineage(split, "tiles")
            leaves = children.join(split.select("face", "path"), ["face", "path"], "left_anti")
        else:
            split, leaves = children.limit(0), children
        level = leaves.withColumn("is_leaf", F.lit(True))
        if depth + 1 == max_depth:
            level = level.unionByName(split.withColumn("is_leaf", F.lit(False)))
        half = size / 4
        level = level.select(
            "face",
            "path",
            F.lit(depth + 1).alias("depth"),
            (F.col("cu") - half).alias("u"),
            (F.col("cv") - half).alias("v"),
            F.lit(size / 2).alias("size"),
            "is_leaf",
            F.lit(depth + 1 == max_depth).alias("is_collision"),
        )
        found = level if found is None else found.unionByName(level)
        parents = split
        if depth < max_depth and split.isEmpty():
            break
    return found


def scatter_assets(
    cells: DataFrame,
    kinds: int,
    radius: float,
    cell_size: float = 300.0,
    fewest: int = MIN_ASSETS,
    most: int = MAX_ASSETS,
    noise: Noise | None = None,
    places: DataFrame | None = None,
    rounding: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Assets of each cell (cx, cy, cz): number, kind, and place on the surface.

    Draws depend only on the cell's seed, so a cell always gets the same assets: they are drawn, and their coordinates
    rounded, once per distinct cell, and every body that has the cell takes the list. Few lists (counted) are broadcast,
    so the cells stay where they are. ``places`` are the distinct cells, if the caller knows them; otherwise the cells are
    written first, since they are read twice.
    """
    place = ["cx", "cy", "cz"]
    if places is None:
        cells = cut_lineage(cells, "cells")
        places = cells.select(*place).distinct()
    drawn = _drawn(places, kinds, radius, cell_size, fewest, most, noise)
    if rounding is not None:
        drawn = drawn.withColumns({a: rounding(F.col(a)) for a in "xyz"})
    fields = ["asset_no", "kind", "x", "y", "z"]
    lists = cut_lineage(drawn.groupBy(*place).agg(F.collect_list(F.struct(*fields)).alias("_assets")), "assets")
    few = lists.count() <= FEW_LISTS
    return cells.join(F.broadcast(lists) if few else lists, place).select(*[F.col(c) for c in cells.columns], F.inline("_assets"))


def _drawn(cells: DataFrame, kinds: int, radius: float, cell_size: float, fewest: int, most: int, noise: Noise | None) -> DataFrame:
    """One row per asset of each cell."""
    seeded = cells.withColumn("_seed", cell_seed(F.col("cx"), F.col("cy"), F.col("cz")))
    span = most - fewest + 1
    count = F.lit(fewest) + F.floor(hash_draw(F.col("_seed"), F.lit(0), F.lit(0)) * span)
    rows = seeded.withColumn("asset_no", F.explode(F.sequence(F.lit(1).cast("bigint"), count)))

    def draw(k: int) -> Column:
        return hash_draw(F.col("_seed"), F.col("asset_no"), F.lit(k))

    inside = tuple((F.col(f"c{a}") + draw(k) * JITTER) * cell_size for k, a in enumerate("xyz", start=1))
    rows = rows.withColumns({f"_d{a}": d for a, d in zip("xyz", vec_normalize(inside))})
    unit = tuple(F.col(f"_d{a}") for a in "xyz")
    lift = terrain_elevation(noise(unit)) if noise else F.lit(0.0)
    return rows.select(
        *cells.columns,
        "asset_no",
        F.floor(draw(4) * kinds).cast("int").alias("kind"),
        *[(d * (radius + lift)).alias(a) for a, d in zip("xyz", unit)],
    )


def tile_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Tiles to load, unload and keep between two leaf sets."""
    return chunk_changes(new, old, keys)
