"""Elevation layers and cube-sphere geometry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worldstate.functions.vectors import Vec, vec_normalize


class NoiseLayer(NamedTuple):
    noise_type: str
    amplitude: float
    clamp_min: float
    clamp_max: float


# fixed values: the three elevation layers (plateau, mountains, detail)
LAYERS = (
    NoiseLayer("macro", 300.0, 300.0, 350.0),
    NoiseLayer("macro", 270.0, 350.0, 1000.0),
    NoiseLayer("micro", 10.0, 0.0, 10000.0),
)
# fixed values: face normals front, right, left, back, top, bottom
FACES = ((0, 0, -1), (1, 0, 0), (-1, 0, 0), (0, 0, 1), (0, 1, 0), (0, -1, 0))


def terrain_elevation(noise: Mapping[str, Column], layers: Sequence[NoiseLayer] = LAYERS) -> Column:
    """Sum of clamped layers; ``noise`` maps a layer type to its noise column."""
    total = F.lit(0.0)
    for layer in layers:
        raised = (noise[layer.noise_type] + 0.5) * layer.amplitude
        total = total + F.greatest(F.least(raised, F.lit(layer.clamp_max)), F.lit(layer.clamp_min))
    return total


def face_axes(face: Column) -> tuple[Vec, Vec, Vec]:
    """(normal, axisA, axisB) of a face number; axisA = (n.y, n.z, n.x), axisB = n × axisA."""

    def pick(values: Sequence[float]) -> Column:
        return F.element_at(F.array(*[F.lit(float(v)) for v in values]), face.cast("int") + 1)

    def axis_a(n):
        return n[1], n[2], n[0]

    def cross(a, b):
        return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]

    a_rows = [axis_a(n) for n in FACES]
    b_rows = [cross(n, a) for n, a in zip(FACES, a_rows)]
    return tuple(tuple(pick([row[i] for row in rows]) for i in range(3)) for rows in (FACES, a_rows, b_rows))


def point_on_face(face: Column, u: Column, v: Column) -> Vec:
    """Point of the cube face before projection."""
    normal, axis_a, axis_b = face_axes(face)
    return tuple(n + u * a + v * b for n, a, b in zip(normal, axis_a, axis_b))


def cube_to_sphere(face: Column, u: Column, v: Column, radius: Column | float) -> Vec:
    radius = F.lit(float(radius)) if isinstance(radius, (int, float)) else radius
    return tuple(p * radius for p in vec_normalize(point_on_face(face, u, v)))


def with_unit_direction(df: DataFrame, face: Column, u: Column, v: Column, names: Sequence[str]) -> DataFrame:
    """Adds the unit direction of a face point as three columns.

    Computed in steps, each a small projection, so that shared parts are evaluated once.
    """
    temps = [f"_face_{n}" for n in names]
    staged = df.withColumns(dict(zip(temps, point_on_face(face, u, v))))
    x, y, z = (F.col(t) for t in temps)
    staged = staged.withColumn("_face_length", F.sqrt(x * x + y * y + z * z))
    unit = {n: F.col(t) / F.col("_face_length") for n, t in zip(names, temps)}
    return staged.withColumns(unit).drop(*temps, "_face_length")


def hash_draw(*parts: Column) -> Column:
    """Number in [0, 1) that depends only on ``parts``: the first 52 bits of the MD5 of their texts."""
    digits = F.substring(F.md5(F.concat_ws(",", *[p.cast("string") for p in parts]).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def point_on_sphere(df: DataFrame, key: Sequence[str], centre: Vec, radius: Column) -> DataFrame:
    """Adds px, py, pz: a place one unit above a sphere, uniform over it and fixed per key."""
    seed = [F.col(c) for c in key]
    theta = hash_draw(*seed, F.lit(1)) * (2 * math.pi)
    phi = F.acos(F.lit(1.0) - hash_draw(*seed, F.lit(2)) * 2)
    unit = (F.sin(phi) * F.cos(theta), F.sin(phi) * F.sin(theta), F.cos(phi))
    return df.withColumns({f"p{n}": c + e * (radius + 1.0) for n, c, e in zip("xyz", centre, unit)})
