"""Windows and sessions of streams with an own watermark, so that late rows are kept apart and counted.

A micro-batch is split at the watermark that the batches before it have set: a row whose own window has ended
by then is late, as is one without a time. Late rows go to ``<path>/late`` in folders by batch, all others into
partial windows, and the counts and the latest time into the manifest, in one commit. For every committed
batch, rows in = rows in windows + rows late. A repeated batch meets the same watermark and writes the same.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from worldstate.operators.ordered import ROWS_PER_TASK
from worldstate.operators.telemetry import MEASURES
from worldstate.streaming.deltas import ReducedTable
from worldstate.streaming.sessions import merged_spans, row_end
from worldstate.streaming.state_table import UNTIL_READ


class RowCounts(NamedTuple):
    rows_in: int
    rows_late: int
    watermark_us: int | None  # microseconds; None before the first batch


class CountedTable(ReducedTable):
    """Partial windows of all batches; subclasses say when a row's window ends and what it adds."""

    def __init__(self, path: str, schema: str, input_schema: str, at: str, delay: str, **levels: int):
        super().__init__(path, schema, **levels)
        self.input_schema, self.at, self.delay = input_schema, at, delay

    def end_of(self) -> Column:
        """End of the window of one row."""
        raise NotImplementedError

    def partial(self, rows: DataFrame) -> DataFrame:
        """Rows in time as partial windows of ``schema``, not yet merged."""
        raise NotImplementedError

    def counts(self, spark: SparkSession) -> RowCounts:
        note = self.log.manifest(spark).note
        return RowCounts(note.get("rows_in", 0), note.get("rows_late", 0), note.get("watermark_us"))

    def late(self, spark: SparkSession) -> DataFrame:
        """All late rows of committed batches, with their ``batch``."""
        schema = f"{self.input_schema}, batch bigint"
        if not self.counts(spark).rows_late:
            return spark.createDataFrame([], schema)
        rows = spark.read.schema(schema).option("basePath", f"{self.path}/late").parquet(f"{self.path}/late")
        return rows.filter(F.col("batch") <= self.log.manifest(spark).batch)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        if self.log.has(spark, batch_id):
            return
        before = self.counts(spark)
        ended = F.unix_micros(self.end_of()) <= F.lit(before.watermark_us).cast("bigint")
        inputs = T.StructType.fromDDL(self.input_schema)
        columns = inputs.names
        late = F.col(self.at).isNull() | F.coalesce(ended, F.lit(False))
        typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in inputs])
        marked = typed.withColumn("_late", late).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            reach = F.max(F.unix_micros(F.col(self.at) - F.expr(f"interval {self.delay}")))
            n, n_late, mark = marked.agg(F.count(F.lit(1)), F.count_if("_late"), reach).first()
            if n_late:
                marked.filter("_late").select(*columns).write.mode("overwrite").parquet(f"{self.path}/late/batch={batch_id}")
            marks = [m for m in (before.watermark_us, mark) if m is not None]
            note = {"rows_in": before.rows_in + n, "rows_late": before.rows_late + n_late, "watermark_us": max(marks, default=None)}
            on_time = marked.filter("not _late").select(*columns)
            self.log.append(self.reduce(self.partial(on_time)), batch_id, self.reduce, note)
        finally:
            marked.unpersist()


class MetricsTable(CountedTable):
    """Tumbling windows of server metrics: sums, counts and maxima per batch, merged when read."""

    def __init__(self, path: str, width: str = "1 minute", delay: str = "10 minutes", at: str = "ts", **levels: int):
        parts = ", ".join(f"sum_{m} double, n_{m} bigint, max_{m} double" for m in MEASURES)
        schema = f"server_id int, window_start timestamp, samples bigint, {parts}"
        inputs = f"server_id int, {at} timestamp, " + ", ".join(f"{m} double" for m in MEASURES)
        super().__init__(path, schema, inputs, at, delay, **levels)
        self.width = width

    def _bounds(self) -> tuple[Column, Column]:
        """Start and end of a row's window; ``F.window`` itself would drop rows without a time."""
        width = F.expr(f"unix_micros(timestamp_seconds(0) + interval {self.width})")
        micros = F.unix_micros(self.at)
        start = micros - F.pmod(micros, width)
        return F.timestamp_micros(start), F.timestamp_micros(start + width)

    def end_of(self) -> Column:
        return self._bounds()[1]

    def partial(self, rows: DataFrame) -> DataFrame:
        values = [c for m in MEASURES for c in (F.col(m).alias(f"sum_{m}"), F.col(m).isNotNull().cast("bigint").alias(f"n_{m}"), F.col(m).alias(f"max_{m}"))]
        timed = rows.withColumn("window_start", self._bounds()[0])
        return timed.select("server_id", "window_start", F.lit(1).cast("bigint").alias("samples"), *values)

    def reduce(self, rows: DataFrame) -> DataFrame:
        aggs = [agg(c).alias(c) for m in MEASURES for agg, c in ((F.sum, f"sum_{m}"), (F.sum, f"n_{m}"), (F.max, f"max_{m}"))]
        return rows.groupBy("server_id", "window_start").agg(F.sum("samples").alias("samples"), *aggs)

    def current(self, spark: SparkSession) -> DataFrame:
        """Windows so far, in the columns of ``metrics_windows``."""
        means = [c for m in MEASURES for c in (F.expr(f"sum_{m} / nullif(n_{m}, 0)").alias(f"avg_{m}"), F.col(f"max_{m}"))]
        return self.reduce(self.changes(spark)).select("server_id", "window_start", "samples", *means)


class SessionTable(CountedTable):
    """Sessions per player: spans that overlap are one, within a batch as between batches."""

    def __init__(
        self, path: str, gap: str, delay: str = "10 minutes", key: str = "entity_id", key_type: str = "bigint",
        at: str = "ts", op: str = "op", rows_per_task: int = ROWS_PER_TASK, **levels: int,
    ):
        schema = f"{key} {key_type}, started_at timestamp, ended_at timestamp, events bigint"
        super().__init__(path, schema, f"{key} {key_type}, {at} timestamp, {op} string", at, delay, **levels)
        self.gap, self.key, self.op, self.rows_per_task = gap, key, op, rows_per_task

    def end_of(self) -> Column:
        return row_end(self.at, self.gap, self.op)

    def partial(self, rows: DataFrame) -> DataFrame:
        return rows.select(
            self.key, F.col(self.at).alias("started_at"), self.end_of().alias("ended_at"), F.lit(1).cast("bigint").alias("events")
        )

    def reduce(self, rows: DataFrame) -> DataFrame:
        return merged_spans(rows, self.key, self.rows_per_task)

    def current(self, spark: SparkSession) -> DataFrame:
        """Sessions so far; those that ended before the watermark can't change any more."""
        return self.reduce(self.changes(spark))


def windows_stream(rows: DataFrame, table: CountedTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep ``table`` up to date from a stream of samples or player events."""
    return (
        rows.writeStream.foreachBatch(lambda batch, batch_id: table.write(batch, batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or UNTIL_READ))
        .start()
    )
