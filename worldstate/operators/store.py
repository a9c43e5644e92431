"""Entity store on plain tables: lookups, upserts, deletes, outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worldstate.functions.ids import stable_uid


def find_by_id(entities: DataFrame, uid: str) -> DataFrame:
    return entities.filter(F.col("uid") == uid)


def find_by_name(entities: DataFrame, name: str, kind: str, kinds: str = "types") -> DataFrame:
    """Exact name, and ``kind`` among the entity's types."""
    return entities.filter((F.col("name") == name) & F.array_contains(kinds, kind))


def name_term_search(entities: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Entities whose name contains any of the terms as a whole word, ignoring case."""
    wanted = F.array(*[F.lit(t.lower()) for t in terms])
    return entities.filter(F.arrays_overlap(F.split(F.lower("name"), r"\W+"), wanted))


def upsert_entities(current: DataFrame, changes: DataFrame, key: str = "uid", identity: str | None = None) -> DataFrame:
    """Known key: given (non-null) fields overwrite, others stay. Unknown key: new row.

    ``changes`` holds one row per entity. A new row without a key gets one derived from its
    ``identity`` column, so that a repeated task assigns the same id.
    """
    fields = [c for c in current.columns if c != key]
    if identity is not None:
        changes = changes.withColumn(key, F.coalesce(F.col(key), stable_uid(F.col(identity))))
    given = [c for c in fields if c in changes.columns]
    new = changes.select(key, *[F.col(c).alias(f"_{c}") for c in given])
    return current.join(new, key, "full").select(
        key, *[F.coalesce(f"_{c}", c).alias(c) if c in given else F.col(c) for c in fields]
    )


def delete_entities(current: DataFrame, uids: DataFrame, key: str = "uid") -> DataFrame:
    return current.join(uids.select(key).distinct(), key, "left_anti")


def save_outcome(df: DataFrame) -> DataFrame:
    """Adds ``outcome`` of each save: created, uid changed, updated or failed."""
    answered = F.col("new_uid") != ""
    outcome = (
        F.when(~F.col("success"), "failed")
        .when(answered & F.col("is_new"), "created")
        .when(answered & (F.col("new_uid") != F.col("uid")), "uid changed")
        .when(answered | (F.col("uid") != ""), "updated")
        .otherwise("failed")
    )
    return df.withColumn("outcome", outcome)


def save_outcomes(results: DataFrame) -> DataFrame:
    return save_outcome(results).groupBy("outcome").agg(F.count(F.lit(1)).alias("requests"))
