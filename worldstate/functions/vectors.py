"""Column maths on (x, y, z) triples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str = "", names: str = "xyz") -> Vec:
    """The columns ``<prefix>x, <prefix>y, <prefix>z``."""
    return tuple(F.col(f"{prefix}{n}") for n in names)


def vec_distance_sq(a: Vec, b: Vec) -> Column:
    dx, dy, dz = (p - q for p, q in zip(a, b))
    return dx * dx + dy * dy + dz * dz


def vec_distance(a: Vec, b: Vec) -> Column:
    return F.sqrt(vec_distance_sq(a, b))


def vec_dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def vec_length(a: Vec) -> Column:
    return F.sqrt(vec_dot(a, a))


def vec_cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def vec_normalize(a: Vec) -> Vec:
    """Unit vector; the zero vector stays zero."""
    length = vec_length(a)
    return tuple(F.when(length == 0, F.lit(0.0)).otherwise(p / length) for p in a)


def vec_direction(origin: Vec, target: Vec) -> Vec:
    """Unit vector from ``origin`` towards ``target``."""
    return vec_normalize(tuple(t - o for o, t in zip(origin, target)))
