"""Size classes, chunk and cell keys, movement tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: size classes and their upper bounds, chunk edge per class
SMALL, MEDIUM, LARGE, HUGE = 0, 1, 2, 3
SIZE_THRESHOLDS = (0.5, 2.0, 8.0)
CHUNK_SIZES = (8.0, 16.0, 64.0)
HUGE_CHUNK = 9999999999999.0
# fixed values: cell seed multipliers
SEED_X, SEED_Y, SEED_Z = 73856093, 19349663, 83492791


def size_category(size: Column, thresholds: Sequence[float] = SIZE_THRESHOLDS) -> Column:
    """Index of the first threshold not exceeded (inclusive); above all of them HUGE."""
    out = F.when(size <= thresholds[0], F.lit(0))
    for i, bound in enumerate(thresholds[1:], start=1):
        out = out.when(size <= bound, F.lit(i))
    return out.otherwise(F.lit(len(thresholds)))


def _truncated(value: Column) -> Column:
    return value.cast("bigint")  # casts of DOUBLE truncate towards zero


def chunk_position(
    x: Column, z: Column, category: Column, sizes: Sequence[float] = CHUNK_SIZES
) -> tuple[Column, Column]:
    """Chunk key (cx, cz); truncation makes chunk 0 twice as wide, HUGE falls on (0, 0)."""
    edge = F.when(category == 0, F.lit(sizes[0]))
    for i, size in enumerate(sizes[1:], start=1):
        edge = edge.when(category == i, F.lit(size))
    edge = edge.otherwise(F.lit(HUGE_CHUNK))
    return _truncated(x / edge), _truncated(z / edge)


def cell_of_position(x: Column, y: Column, z: Column, cell_size: float = 300.0) -> tuple[Column, Column, Column]:
    return tuple(_truncated(v / F.lit(float(cell_size))) for v in (x, y, z))


def cell_seed(cx: Column, cy: Column, cz: Column) -> Column:
    """Products combined by exclusive or, in BIGINT."""
    a, b, c = (v.cast("bigint") * F.lit(m) for v, m in ((cx, SEED_X), (cy, SEED_Y), (cz, SEED_Z)))
    return a.bitwiseXOR(b).bitwiseXOR(c)


def moved_whole_unit(current: Sequence[Column], last: Sequence[Column]) -> Column:
    """Changed, and its floor differs from the stored (already floored) position."""
    changed = F.lit(False)
    crossed = F.lit(False)
    for now, before in zip(current, last):
        changed = changed | (now != before)
        crossed = crossed | (F.floor(now).cast("double") != before)
    return changed & crossed


def scale_coordinates(df: DataFrame, columns: Sequence[str] = ("x", "y", "z"), factor: float = 100.0) -> DataFrame:
    """Map units to world units."""
    return df.withColumns({c: F.col(c) * F.lit(float(factor)) for c in columns})
