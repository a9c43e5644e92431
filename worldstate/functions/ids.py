"""Identifiers: random ids, numeric fields of a UUID, stable ids derived from a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# byte ranges of the five fields
_FIELDS = {"low": range(0, 4), "mid": range(4, 6), "hi": range(6, 8), "clock": range(8, 10), "node": range(10, 16)}


def with_uuid(df: DataFrame, name: str = "uuid") -> DataFrame:
    """A random version-4 id per row."""
    return df.withColumn(name, F.expr("uuid()"))


def uuid_fields(text: Column, big_endian: bool = True) -> dict[str, Column]:
    """Numeric fields low, mid, hi, clock, node; all fit BIGINT."""
    digits = F.replace(F.lower(text), F.lit("-"), F.lit(""))

    def number(positions: range) -> Column:
        ordered = positions if big_endian else reversed(positions)
        hexed = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in ordered])
        return F.conv(hexed, 16, 10).cast("bigint")

    return {name: number(positions) for name, positions in _FIELDS.items()}


def uuid_equal(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def stable_uid(key: Column) -> Column:
    """Store id of a new entity. Derived from its key: a retried task gives the same id."""
    return F.concat(F.lit("0x"), F.substring(F.md5(key.cast("string")), 1, 16))
