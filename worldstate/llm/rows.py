"""Rows told apart by their whole content, so that work on keys alone can find its rows again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ID = ("__h1", "__h2")
BUCKETS = 1 << 20


def _hashed(docs: DataFrame, name: str) -> list[Column]:
    column = F.col(f"`{name}`")
    kind = docs.schema[name].dataType
    shown = F.to_json(F.struct(column)) if "map" in kind.simpleString() or isinstance(kind, (T.NullType, T.VariantType)) else column
    return [shown, column.isNull()]


def with_row_id(docs: DataFrame) -> DataFrame:
    """Adds two 64-bit hashes of all columns, nulls included; rows alike in all columns have the same."""
    columns = [c for name in docs.columns for c in _hashed(docs, name)]
    return docs.withColumns({ID[0]: F.xxhash64(*columns), ID[1]: F.xxhash64(F.lit(1), *columns)})


def _bucket(column: str = ID[0]) -> Column:
    return F.pmod(F.col(column), F.lit(BUCKETS)).alias("__bucket")


def _buckets(ids: DataFrame) -> DataFrame:
    """Buckets that hold an id: ``BUCKETS`` numbers at most, whatever the number of ids, so they may go to all tasks."""
    return F.broadcast(ids.select(_bucket()).distinct())


def rejoin(docs: DataFrame, wanted: DataFrame, only: dict[str, Column] | None = None, few: bool = False) -> DataFrame:
    """For each row of ``wanted`` its row of ``docs``, or ``only`` some columns, with those that ``wanted`` has besides.

    ``wanted`` has the row ids and ``__rows``, the number of rows of ``docs`` that bear the id. Where that is one,
    as nearly always, rows are joined as they are; of repeated rows one is taken first. With ``few`` wanted rows
    the others are left out before the shuffle, but for those that share a bucket with a wanted one.
    """
    marked = with_row_id(docs)
    if only is not None:
        marked = marked.select(*ID, *[column.alias(name) for name, column in only.items()])
    if few:
        marked = marked.withColumn("__bucket", _bucket()).join(_buckets(wanted), "__bucket", "left_semi").drop("__bucket")
    again = wanted.filter("__rows > 1").drop("__rows")
    once = marked.join(wanted.filter("__rows = 1").drop("__rows"), list(ID))
    if again.isEmpty():
        return once.drop(*ID)
    one = marked.join(again.select(*ID).distinct(), list(ID), "left_semi").dropDuplicates(list(ID))
    return reduce(DataFrame.unionByName, [once, one.join(again, list(ID))]).drop(*ID)


def without(docs: DataFrame, dropped: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` without the rows of the ids ``dropped``, and with one of each of the ids ``repeated``.

    Rows that share no bucket with these ids stay where they are; only the others are shuffled.
    """
    single = not repeated.isEmpty()
    special = dropped.select(*ID, F.lit(False).alias("__one")).union(repeated.select(*ID, F.lit(True)))
    marked = with_row_id(docs).withColumn("__bucket", _bucket())
    plain = marked.join(_buckets(special), "__bucket", "left_anti")
    doubtful = marked.join(_buckets(special), "__bucket", "left_semi").join(special, list(ID), "left")
    parts = [plain, doubtful.filter("__one is null").drop("__one")]
    if single:
        parts.append(doubtful.filter("__one").drop("__one").dropDuplicates(list(ID)))
    return reduce(DataFrame.unionByName, parts).drop(*ID, "__bucket")
