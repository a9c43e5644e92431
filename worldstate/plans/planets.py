"""Queries for planet tiles and scatter."""

from __future__ import annotations

from pyspark.sql import functions as F

from worldstate.operators import chunks, tiles
from worldstate.plans.registry import query
from worldstate.plans.world import NEEDED_SQL
from worldstate.session import cut_lineage
from worldstate.plans.scalars import _ELEVATION, FACE_SQL, PLANE_SQL, draw_sql, r6

RADIUS, DEPTH = 8000.0, tiles.MAX_DEPTH
_UNIT = "sqrt(px*px + py*py + pz*pz)"


def _quadtree_sql(focus: str) -> str:
    """The levels of the tree written out, one pair of CTEs each."""
    parts = [f"faces as (select * from {FACE_SQL})", "split_up as (select face, 'Chunk_0' as path, 0e0 as cu, 0e0 as cv from faces)"]
    leaves, parent = [], "split_up"
    for d in range(DEPTH + 1):
        size = 2.0 / 2**d
        q, reach = size / 4, (RADIUS * size * 0.7) ** 2
        parts.append(
            f"""child{d} as (select face, path || '_' || cast(i as varchar) as path, cu + (i % 2 * 2 - 1) * {q}e0 as cu,
              cv + (i // 2 * 2 - 1) * {q}e0 as cv from {parent} cross join range(4) c(i))"""
        )
        if d < DEPTH:
            parts.append(
                f"""split{d} as (select face, path, cu, cv from (select face, path, cu, cv, px / {_UNIT} * {RADIUS}e0 as sx,
                  py / {_UNIT} * {RADIUS}e0 as sy, pz / {_UNIT} * {RADIUS}e0 as sz
                  from (select face, path, cu, cv, {PLANE_SQL.format(u='cu', v='cv')} from child{d} join faces using (face)) p) s
                where exists (select 1 from {focus} f where (sx-f.x)*(sx-f.x) + (sy-f.y)*(sy-f.y) + (sz-f.z)*(sz-f.z) <= {reach!r}))"""
            )
            leaf = f"(select c.* from child{d} c left join split{d} s on c.face = s.face and c.path = s.path where s.path is null)"
        else:
            leaf = f"child{d}"
        fields = f"face, path, {d + 1} as depth, cu - {q}e0 as u, cv - {q}e0 as v, {size / 2}e0 as size"
        at_depth = "true" if d + 1 == DEPTH else "false"
        leaves.append(f"select {fields}, true as is_leaf, {at_depth} as is_collision from {leaf} l{d}")
        if d + 1 == DEPTH:
            leaves.append(f"select {fields}, false as is_leaf, true as is_collision from split{d}")
        parent = f"split{d}"
    parts.append("tiles as (" + " union all ".join(leaves) + ")")
    return "with " + ",\n".join(parts)


_TREE = _quadtree_sql("latest")


def _tiles(v, focus=None):
    return tiles.quadtree_tiles(v.spark, v.latest if focus is None else focus, RADIUS, DEPTH)


@query(f"{_TREE} select * from tiles")
def quadtree_tiles(v):
    return _tiles(v)


def _noise(unit):
    return {"macro": unit[0], "micro": unit[2]}


_SCATTER = f"""with draws as (
      select body_id, c.cx, c.cy, c.cz, asset_no, xor(xor(c.cx*73856093, c.cy*19349663), c.cz*83492791) as seed
      from ({NEEDED_SQL}) c cross join range(1, 11) a(asset_no)),
    places as (select *, {", ".join(f"(c{a} + {draw_sql('seed', 'asset_no', str(k))} * 0.5e0) * 300e0 as i{a}" for k, a in enumerate("xyz", 1))}
      from draws where asset_no <= 3 + floor({draw_sql('seed', '0', '0')} * 8)),
    units as (select *, {", ".join(f"i{a} / sqrt(ix*ix + iy*iy + iz*iz) as u{a}" for a in "xyz")} from places),
    lifted as (select *, 2000e0 + ({_ELEVATION.replace("macro", "ux").replace("micro", "uz")}) as height from units)
    select body_id, cx, cy, cz, cast(asset_no as bigint) as asset_no, cast(floor({draw_sql('seed', 'asset_no', '4')} * 4) as int) as kind,
      {", ".join(f"round(u{a} * height, 6) + 0e0 as {a}" for a in "xyz")} from lifted"""


@query(_SCATTER)
def scatter_assets(v):
    return _scattered(*chunks.needed_cells_and_places(v.latest, v.fields))


def _scattered(cells, places):
    return tiles.scatter_assets(cells, kinds=4, radius=2000.0, noise=_noise, places=places, rounding=r6)


@query(f"select *, true as as_designed from ({NEEDED_SQL}) c")
def scatter_per_cell(v):
    """Draws cannot be compared; number, kinds and height of each cell's assets can."""
    cells, places = chunks.needed_cells_and_places(v.latest, v.fields)
    place = ["cx", "cy", "cz"]
    places = cut_lineage(places, "places")
    rows = _scattered(places, places)  # a cell has the same assets with every body
    height = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    checked = rows.groupBy(*place).agg(
        F.count(F.lit(1)).alias("n"), F.max("asset_no").alias("last"), F.min("kind").alias("k0"), F.max("kind").alias("k1"),
        F.min(height).alias("h0"), F.max(height).alias("h1"),
    )
    good = "n between 3 and 10 and last = n and k0 >= 0 and k1 < 4 and h0 > 2649.999 and h1 < 2770.001"
    checked = cut_lineage(checked.select(*place, F.expr(good).alias("as_designed")), "checked")
    few = checked.count() <= tiles.FEW_LISTS
    return cells.join(F.broadcast(checked) if few else checked, place).select("body_id", *place, "as_designed")


_EARLY = "(select arg_min(x, row(ts, seq)) as x, arg_min(y, row(ts, seq)) as y, arg_min(z, row(ts, seq)) as z from moves where op = 'add' group by entity_id)"


@query(
    f"""select coalesce(a.face, b.face) as face, coalesce(a.path, b.path) as path,
      case when b.path is null then 'load' when a.path is null then 'unload' else 'keep' end as action
    from ({_TREE} select face, path from tiles where is_leaf) a
      full join ({_quadtree_sql(_EARLY)} select face, path from tiles where is_leaf) b on a.face = b.face and a.path = b.path"""
)
def tile_changes(v):
    first = F.min_by(F.struct("x", "y", "z"), F.struct("ts", "seq")).alias("p")
    early = v.moves.filter("op = 'add'").groupBy("entity_id").agg(first).select("p.*")
    old = _tiles(v, early).filter("is_leaf")
    return tiles.tile_changes(old, _tiles(v).filter("is_leaf"), ["face", "path"])
