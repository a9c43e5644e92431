"""Current state of a change feed as a table of levelled deltas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from worldstate.operators.feeds import keep_last_messages, latest_state, local_remote, merge_partial_updates
from worldstate.operators.ordered import last_row
from worldstate.streaming.deltas import ReducedTable


class StateTable(ReducedTable):
    """Last change per key, deletes included, so that late changes still lose to them.

    ``current`` takes the latest change per key; deltas are merged while the stream writes.
    """

    def __init__(self, path: str, keys: Sequence[str], order: Sequence[str], schema: str, **levels: int):
        super().__init__(path, schema, **levels)
        self.keys, self.order = list(keys), list(order)

    def reduce(self, rows: DataFrame) -> DataFrame:
        return last_row(rows, self.keys, self.order)

    def current(self, spark: SparkSession) -> DataFrame:
        return latest_state(self.changes(spark), self.keys, self.order)

    def _moved(self, into: str) -> StateTable:
        return StateTable(into, self.keys, self.order, self.schema)

    def compact(self, spark: SparkSession, into: str) -> StateTable:
        """A new table at ``into`` with one delta, which counts as a seed."""
        small = self._moved(into)
        small.log.append(self.reduce(self.changes(spark)), -1, self.reduce)
        return small


class PartialStateTable(StateTable):
    """State of a feed whose updates may leave out fields: the changes that still matter are, per key, the
    latest delete, and after it the latest change of each field and the latest change at all."""

    def __init__(self, path: str, keys: Sequence[str], order: Sequence[str], schema: str, fields: Sequence[str], **levels: int):
        super().__init__(path, keys, order, schema, **levels)
        self.fields = list(fields)

    def _moved(self, into: str) -> PartialStateTable:
        return PartialStateTable(into, self.keys, self.order, self.schema, self.fields)

    def reduce(self, rows: DataFrame) -> DataFrame:
        position, deleted = F.struct(*self.order), F.col("op") == "delete"
        gone = rows.filter(deleted).groupBy(*self.keys).agg(F.max(position).alias("_gone"))
        since = rows.join(gone, self.keys, "left").filter(F.col("_gone").isNull() | (position >= F.col("_gone")))
        latest = [F.max(F.when(~deleted & F.col(f).isNotNull(), position)) for f in self.fields]
        wanted = F.array_distinct(F.array_compact(F.array(F.max(position), F.max("_gone"), *latest)))
        winners = since.groupBy(*self.keys).agg(wanted.alias("_w")).select(*self.keys, F.inline("_w"))
        return rows.join(winners, [*self.keys, *self.order], "left_semi").select(*rows.columns)

    def current(self, spark: SparkSession) -> DataFrame:
        return merge_partial_updates(self.changes(spark), self.keys, self.order, self.fields)


UNTIL_READ = {"availableNow": True}  # default trigger; pass processingTime="…" to keep running


def entity_state_stream(
    feed: DataFrame, table: StateTable, checkpoint: str, own_server: int | None = None, **trigger
) -> StreamingQuery:
    """Maintain ``table`` from a stream of change rows (op, keys, order, entity fields).

    Add and update both put the row, a delete removes it, unknown deletes are harmless. Rows of
    ``own_server`` are ignored.
    """
    if own_server is not None:
        feed = local_remote(feed, own_server)
    columns = [c.strip().split()[0] for c in table.schema.split(",")]
    return (
        feed.select(*columns)
        .writeStream.foreachBatch(lambda batch, batch_id: table.write(batch, batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or UNTIL_READ))
        .start()
    )


def zone_state_stream(changes: DataFrame, table: PartialStateTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Zones after server changes; partial updates keep name, ip and port."""
    return entity_state_stream(changes, table, checkpoint, **trigger)


def seed_snapshot(table: StateTable, snapshot: DataFrame, batch_id: int = -1) -> None:
    """Store a snapshot as a delta of its own; a repeat changes nothing.

    Its rows must carry order values smaller than those of all later changes.
    """
    table.write(snapshot.withColumn("op", F.lit("add")), batch_id)


class LastMessages(ReducedTable):
    """The last ``n`` chat lines per channel; a delta holds at most n lines per channel."""

    def __init__(self, path: str, schema: str, keys: Sequence[str], order: Sequence[str], n: int = 50, **levels: int):
        super().__init__(path, schema, **levels)
        self.keys, self.order, self.n = list(keys), list(order), n

    def reduce(self, rows: DataFrame) -> DataFrame:
        return keep_last_messages(rows, self.keys, self.order, self.n)

    def current(self, spark: SparkSession) -> DataFrame:
        return self.reduce(self.changes(spark))
