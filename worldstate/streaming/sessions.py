"""Player sessions: session windows on streams, prefix scans on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worldstate.operators.ordered import ROWS_PER_TASK, Ordered

AFTER_DISCONNECT = "1 second"


def _gap(gap: str, op: str) -> Column:
    return F.when(F.col(op) == "delete", F.lit(AFTER_DISCONNECT)).otherwise(F.lit(gap))


def player_sessions_stream(
    events: DataFrame, gap: str, key: str = "entity_id", at: str = "ts", op: str = "op", delay: str = "10 minutes"
) -> DataFrame:
    """Sessions per player from connect / update / disconnect rows.

    A row keeps the session open for ``gap``, a disconnect for one second. Servers do not matter,
    so a hop continues the session. Rows later than ``delay`` are dropped by the watermark.
    """
    timed = events.withWatermark(at, delay) if events.isStreaming else events
    spans = timed.groupBy(key, F.session_window(at, _gap(gap, op)).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return spans.select(key, F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "events")


def row_end(at: str, gap: str, op: str = "op") -> Column:
    """Time until which one row keeps the session open."""
    return F.when(F.col(op) == "delete", F.expr(f"`{at}` + interval {AFTER_DISCONNECT}")).otherwise(
        F.expr(f"`{at}` + interval {gap}")
    )


def merged_spans(spans: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Spans (key, started_at, ended_at, events) of a key that touch or overlap become one.

    No sort of whole keys in one task: a span starts a new one when it comes after the latest end of all before it.
    """
    order = ["started_at", "ended_at"]
    scan = Ordered(spans.select(key, *order, "events"), [key], order, rows_per_task)
    scan = scan.running_max("_reach", F.col("ended_at")).lag("_open", F.col("_reach"))
    starts = (F.col("_open").isNull() | (F.col("started_at") > F.col("_open"))).cast("bigint")
    merged = scan.running_sum("_session", starts).result().groupBy(key, "_session").agg(
        F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"), F.sum("events").alias("events")
    )
    return merged.drop("_session")


def player_sessions(
    events: DataFrame,
    gap: str,
    key: str = "entity_id",
    order=("ts", "seq"),
    op: str = "op",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Batch twin without a sort of whole players in one task: a row starts a session when it comes
    after the latest end of all rows before it."""
    at = order[0]
    rows = events.select(key, *order, row_end(at, gap, op).alias("_end"))
    scan = Ordered(rows, [key], order, rows_per_task).running_max("_reach", F.col("_end")).lag("_open", F.col("_reach"))
    starts = (F.col("_open").isNull() | (F.col(at) > F.col("_open"))).cast("bigint")
    numbered = scan.running_sum("_session", starts).result()
    spans = numbered.groupBy(key, "_session").agg(
        F.min(at).alias("started_at"), F.max("_end").alias("ended_at"), F.count(F.lit(1)).alias("events")
    )
    return spans.drop("_session")
