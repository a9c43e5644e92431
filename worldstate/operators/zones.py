"""Zone ownership: who owns a point, who is out of zone, transfers, overload and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worldstate.operators.boxes import first_box
from worldstate.operators.ordered import ROWS_PER_TASK, Ordered
from worldstate.session import cut_lineage

# fixed values: zone used when a server has none, player limit before a split, missing player name
DEFAULT_BOUND = 100000.0
MAX_PLAYERS = 2
NO_NAME = "Pigeon with no name"

BOUNDS = [f"{axis}_{end}" for axis in "xyz" for end in ("start", "end")]


def _holds(zone, x: Column, y: Column, z: Column) -> Column:
    """Lower bounds belong to the zone, upper bounds do not."""
    out = F.lit(True)
    for axis, value in zip("xyz", (x, y, z)):
        out = out & (zone(f"{axis}_start") <= value) & (value < zone(f"{axis}_end"))
    return out


def zone_assign(
    points: DataFrame,
    zones: DataFrame,
    key: Sequence[str],
    own: str | None = "server_id",
) -> DataFrame:
    """Adds ``target_id, target_name``: first zone in ``seq`` order that holds (x, y, z).

    The point's ``own`` server is skipped; null when no zone holds it. Points look up the zones
    of their grid cell, so they aren't shuffled while Spark can broadcast the zones. ``key`` must be unique. A zone
    with a null bound holds nothing, one with an infinite bound is unlimited there.
    """
    zones = zones.select("seq", "id", "name", *[F.col(b).cast("double").alias(b) for b in BOUNDS])
    x, y, z = (F.col(c).cast("double") for c in "xyz")

    def fits(zone: Column) -> Column:
        inside = _holds(lambda bound: zone[bound], x, y, z)
        return inside if own is None else inside & ~zone["id"].eqNullSafe(F.col(own))

    lows, highs = ([F.col(f"{a}_{end}") for a in "xyz"] for end in ("start", "end"))
    found = first_box(points, zones, key, (x, y, z), lows, highs, fits)
    return found.select(*points.columns, F.col("_hit.id").alias("target_id"), F.col("_hit.name").alias("target_name"))


def in_own_zone(points: DataFrame, zones: DataFrame) -> DataFrame:
    """Adds ``failed_axis``: first of X, Y, Z on which the point left its server's zone, else null.

    Here both bounds belong to the zone. A server without a zone row has the default zone.
    """
    bounds = zones.select(F.col("id").alias("_zone_id"), *[F.col(b).cast("double").alias(f"_{b}") for b in BOUNDS])
    axis = None
    for name in "xyz":
        value = F.col(name).cast("double")
        low = F.coalesce(F.col(f"_{name}_start"), F.lit(-DEFAULT_BOUND))
        high = F.coalesce(F.col(f"_{name}_end"), F.lit(DEFAULT_BOUND))
        outside = (value < low) | (value > high)
        axis = F.when(outside, name.upper()) if axis is None else axis.when(outside, name.upper())
    joined = points.join(bounds, F.col("server_id") == F.col("_zone_id"), "left")
    return joined.withColumn("failed_axis", axis).select(*points.columns, "failed_axis")


def out_of_zone(
    points: DataFrame, zones: DataFrame, key: Sequence[str], in_transfer: DataFrame | None = None
) -> DataFrame:
    """Points outside their own zone, with the failing axis; points in transfer are skipped."""
    if in_transfer is not None:
        points = points.join(in_transfer.select(*key).distinct(), list(key), "left_anti")
    return in_own_zone(points, zones).filter(F.col("failed_axis").isNotNull())


def plan_transfers(
    points: DataFrame,
    zones: DataFrame,
    key: Sequence[str],
    in_transfer: DataFrame | None = None,
) -> DataFrame:
    """Out-of-zone points with their target server; ``status`` is transfer or no_server."""
    moving = zone_assign(out_of_zone(points, zones, key, in_transfer), zones, key)
    return moving.withColumn("status", F.when(F.col("target_id").isNull(), "no_server").otherwise("transfer"))


def new_player_placement(spawned: DataFrame, zones: DataFrame, key: Sequence[str]) -> DataFrame:
    """Freshly spawned points that lie in another server's zone and are sent there at once."""
    return zone_assign(spawned, zones, key).filter(F.col("target_id").isNotNull())


def remote_labels(players: DataFrame, zones: DataFrame, name: str = "name") -> DataFrame:
    """Adds ``label`` (player name or the default) and ``server_label`` (name of the server)."""
    servers = zones.select(F.col("id").alias("server_id"), F.col("name").alias("server_label"))
    labelled = players.withColumn("label", F.coalesce(F.col(name), F.lit(NO_NAME)))
    return labelled.join(servers, "server_id", "left").select(*players.columns, "label", "server_label")


def players_per_server(players: DataFrame) -> DataFrame:
    return players.groupBy("server_id").agg(F.count(F.lit(1)).alias("players"))


def universe_population(players: DataFrame, zones: DataFrame) -> DataFrame:
    """Per observing server: its own players, those of other servers, number of servers."""
    local = players_per_server(players)
    totals = players.agg(F.count(F.lit(1)).alias("n")).scalar()
    servers = zones.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        zones.select(F.col("id").alias("server_id"))
        .join(local, "server_id", "left")
        .select(
            "server_id",
            F.coalesce("players", F.lit(0)).alias("local_players"),
            (totals - F.coalesce("players", F.lit(0))).alias("remote_players"),
            servers.alias("servers"),
        )
    )


def overload_report(
    players: DataFrame,
    zones: DataFrame,
    key: Sequence[str],
    changing: DataFrame | None = None,
    in_transfer: DataFrame | None = None,
    max_players: int = MAX_PLAYERS,
) -> DataFrame:
    """Positions on overloaded servers: ``id, players``, key, ``x, y, z``, one row per placed player.

    A server reports when it has more than ``max_players`` players, is not changing its zone,
    and none of its players is due for transfer (the check starts those transfers instead).
    Positions of exactly (0, 0, 0) are left out: their spawn is not set yet. A server without any
    other position still reports, with one row of null position.
    """
    due = plan_transfers(players, zones, key, in_transfer).filter(F.col("status") == "transfer")
    loaded = players_per_server(players).filter(F.col("players") > max_players)
    loaded = loaded.join(due.select("server_id").distinct(), "server_id", "left_anti")
    if changing is not None:
        loaded = loaded.join(changing.select(F.col("id").alias("server_id")).distinct(), "server_id", "left_anti")
    placed = players.filter((F.col("x") != 0) | (F.col("y") != 0) | (F.col("z") != 0))
    return loaded.join(placed, "server_id", "left").select(F.col("server_id").alias("id"), "players", *key, "x", "y", "z")


def overload_messages(
    report: DataFrame, order: Sequence[str], max_positions: int = 10_000, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Report messages ``(id, part, positions, payload)``; long lists are spread over parts."""
    rows = Ordered(report, ["id"], order, rows_per_task).row_number("_n").result()
    part = F.floor((F.col("_n") - 1) / max_positions).cast("int").alias("part")
    place = F.when(F.col("x").isNotNull(), F.struct("_n", F.struct("x", "y", "z").alias("p")))
    listed = F.sort_array(F.collect_list(place))
    grouped = rows.groupBy("id", part).agg(F.transform(listed, lambda s: s["p"]).alias("players"))
    return grouped.select("id", "part", F.size("players").alias("positions"), F.to_json(F.struct("id", "players")).alias("payload"))


SKETCH = 10_000  # a sketch's rank is off by one part of this at most


def exact_medians(rows: DataFrame, keys: Sequence[str], value: str, count: str) -> DataFrame:
    """``keys, median``: the middle value, or the mean of the two middle ones. ``count``, a key column, has the rows of the key."""
    near = [0.5 - 4 / SKETCH, 0.5 + 4 / SKETCH]
    brackets = rows.groupBy(*keys).agg(F.percentile_approx(value, near, SKETCH).alias("_near"))
    held = rows.join(brackets, list(keys))
    low, high = F.col("_near")[0], F.col("_near")[1]
    below = held.groupBy(*keys).agg(F.count_if(F.col(value) < low).alias("_below"))
    inside = held.filter((F.col(value) >= low) & (F.col(value) <= high)).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = inside.join(below, list(keys)).withColumn("_last", F.col("_below") + F.sum("_c").over(upto))
    middle = F.array_distinct(F.array(F.floor((F.col(count) + 1) / 2), F.floor((F.col(count) + 2) / 2)))
    picked = ranked.withColumn("_rank", F.explode(middle)).filter((F.col("_rank") <= F.col("_last")) & (F.col("_rank") > F.col("_last") - F.col("_c")))
    return picked.groupBy(*keys).agg(F.avg(value).alias("median"))


def split_plan(report: DataFrame, zones: DataFrame) -> DataFrame:
    """Two zones for each reported server: cut at the median of the axis of largest spread.

    The median is selected, not sorted for: a sketch brackets it within a few ten-thousandths of the positions,
    those below the bracket are counted, and only the values inside it are put in order. Equal values are one row.
    """
    placed = report.filter("x is not null and y is not null and z is not null")
    report = cut_lineage(placed.select("id", "x", "y", "z"), "report")  # read again below
    spread = [(F.max(a) - F.min(a)).alias(f"_s{a}") for a in "xyz"]
    wide = report.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), *spread)
    best = F.greatest("_sx", "_sy", "_sz")
    axis = F.when(F.col("_sx") == best, "x").when(F.col("_sz") == best, "z").otherwise("y")
    wide = wide.select("id", "_n", axis.alias("axis"))
    value = F.when(F.col("axis") == "x", F.col("x")).when(F.col("axis") == "y", F.col("y")).otherwise(F.col("z"))
    rows = report.join(wide, "id").select("id", "axis", "_n", value.alias("_v"))
    cuts = exact_medians(rows, ["id", "axis", "_n"], "_v", "_n").withColumnRenamed("median", "cut").drop("_n")
    both = cuts.join(zones.select("id", *BOUNDS), "id").withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))

    def bound(name: str) -> Column:
        on_axis = F.col("axis") == name[0]
        moved = F.lit(1 if name.endswith("start") else 0)
        return F.when(on_axis & (F.col("half") == moved), F.col("cut")).otherwise(F.col(name)).alias(name)

    return both.select("id", "axis", "cut", "half", *[bound(b) for b in BOUNDS])


def zone_split_state(zones: DataFrame) -> DataFrame:
    """Zones under a split or merge order; a merge disables the server."""
    split, merge = F.col("to_split_server_id"), F.col("to_merge_server_id")
    return (
        zones.filter(split.isNotNull() | merge.isNotNull())
        .withColumn("pushes_players", split.isNotNull())
        .withColumn("active", merge.isNull())
        .withColumn("hands_over_to", F.coalesce(merge, split))
    )
