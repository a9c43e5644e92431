"""Gapless numbers within keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALT_DIGITS = 2


def key_text(*columns: Column) -> Column:
    """A text without null that differs wherever the columns differ; null is a value of its own."""
    parts = [F.coalesce(F.concat(F.lit("="), F.replace(c.cast("string"), F.lit("\x1f"), F.lit("\x1f\x1f"))), F.lit("")) for c in columns]
    return F.concat_ws("\x1f,", *parts)


def digest_of(column: Column) -> Column:
    """Hex digest that spreads rows evenly and orders them alike in every run."""
    return F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def number_rows(
    df: DataFrame, key: Column, digest: Column, out: str, ties: tuple[Column, ...] = (), extra: DataFrame | None = None
) -> DataFrame:
    """Adds ``out``: 0, 1, … within each key, in the order of ``digest`` (hex text), then ``ties``.

    A key's rows are numbered in 256 parts by the digest's first two digits; each part then adds
    the number of rows in the parts before it. So no task holds more than a 256th of a key, as
    long as the digests differ. ``extra`` has one row per key (column ``__key``) whose columns are
    added too. Rows alike in all of these columns get consecutive numbers in any order.
    """
    marked = df.withColumns({"__key": key, "__digest": digest}).withColumn(
        "__part", F.conv(F.substring("__digest", 1, SALT_DIGITS), 16, 10).cast("int")
    )
    before = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = marked.groupBy("__key", "__part").agg(F.count(F.lit(1)).alias("__n"))
    parts = parts.select("__key", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    if extra is not None:
        parts = parts.join(extra, "__key")
    inside = Window.partitionBy("__key", "__part").orderBy("__digest", *ties)
    numbered = marked.withColumn("__row", F.row_number().over(inside) - 1)
    found = numbered.join(parts, ["__key", "__part"]).withColumn(out, F.col("__row") + F.col("__before"))
    return found.drop("__key", "__part", "__digest", "__row", "__before")
