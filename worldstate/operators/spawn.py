"""Spawn places and spawn requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worldstate.functions.vectors import vec, vec_direction

# fixed value: a thing spawned without a place appears at this offset from its player
SPAWN_OFFSET = 10.0


def resolve_spawn_point(requests: DataFrame, spawns: DataFrame, bodies: DataFrame) -> DataFrame:
    """Adds x, y, z and up_x, up_y, up_z for ``spawn_point``.

    On a planet up points away from its centre, at a station it is the station's own. An index
    out of range gives the origin and straight up. ``spawns``: idx, kind, body_id, place, own up;
    ``bodies``: id, cx, cy, cz.
    """
    centres = bodies.select(F.col("id").alias("body_id"), "cx", "cy", "cz")
    placed = spawns.join(centres, "body_id", "left")
    away = vec_direction((F.col("cx"), F.col("cy"), F.col("cz")), vec())
    ups = {
        f"up_{n}": F.when(F.col("kind") == "station", F.col(f"up_{n}")).otherwise(F.coalesce(a, F.lit(d)))
        for n, a, d in zip("xyz", away, (0.0, 1.0, 0.0))
    }
    table = placed.withColumns(ups).select(
        F.col("idx").alias("spawn_point"), *[F.col(c).alias(f"_{c}") for c in ("x", "y", "z", *ups)]
    )
    defaults = {"x": 0.0, "y": 0.0, "z": 0.0, "up_x": 0.0, "up_y": 1.0, "up_z": 0.0}
    return requests.join(table, "spawn_point", "left").select(
        *requests.columns, *[F.coalesce(F.col(f"_{c}"), F.lit(d)).alias(c) for c, d in defaults.items()]
    )


def resolve_spawn_request(df: DataFrame) -> DataFrame:
    """Place of a requested thing: ``want_*`` where given, else the player's place plus 10 per axis.

    Rotation likewise: ``want_r*`` or the player's up vector ``up_*``.
    """
    given = F.col("want_x").isNotNull()
    turned = F.col("want_rx").isNotNull()
    out = {}
    for n in "xyz":
        out[f"spawn_{n}"] = F.when(given, F.col(f"want_{n}")).otherwise(F.col(n) + SPAWN_OFFSET)
        out[f"spawn_r{n}"] = F.when(turned, F.col(f"want_r{n}")).otherwise(F.col(f"up_{n}"))
    return df.withColumns(out)
