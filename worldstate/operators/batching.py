"""Write batching: which batch an operation falls in, order, payloads, retries, batch size."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worldstate.operators import ranges
from worldstate.operators.folds import chained_fold
from worldstate.operators.ordered import ROWS_PER_TASK, Ordered, order_value
from worldstate.session import cut_lineage


class BatchConfig(NamedTuple):
    """Fixed values of the batching rule (server settings)."""

    start_size: int = 200
    min_size: int = 20
    max_size: int = 1000
    grow_by: int = 50
    grow_every: int = 20
    shrink_below: float = 80.0
    grow_above: float = 95.0
    settle_after: int = 10
    flush_seconds: float = 5.0
    max_retries: int = 3
    base_delay_ms: int = 50


def next_flush(micros: np.ndarray, urgent: np.ndarray, start: int, held: int, last: float, size: int, wait: float) -> int:
    """Index of the row that flushes a buffer holding ``held`` rows before ``start``; len if none."""
    n = len(micros)
    by_size = start + size - held - 1
    by_time = int(np.searchsorted(micros[start:], last + wait, side="right")) + start
    hit = int(np.argmax(urgent[start:])) + start if urgent[start:].any() else n
    return min(by_size, by_time, hit, n)


def flush_step(size: int, wait_us: float):
    def run(state, rows):
        micros = rows["micros"].to_numpy(dtype="float64")
        urgent = rows["priority"].to_numpy() == 0
        held, last = state if state is not None else (0, float(micros[0]))
        ends = np.zeros(len(micros), dtype=bool)
        start = 0
        while start < len(micros):
            at = next_flush(micros, urgent, start, held, last, size, wait_us)
            if at >= len(micros):
                held += len(micros) - start
                break
            ends[at] = True
            held, last, start = 0, float(micros[at]), at + 1
        return [held, last], {"ends_batch": ends}

    return run


def batch_assign(
    ops: DataFrame,
    keys: Sequence[str] = ("server_id",),
    order: Sequence[str] = ("ts", "seq"),
    config: BatchConfig = BatchConfig(),
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Adds ``batch_no`` (from 1 per key).

    A batch ends with the operation that makes it full, comes more than five seconds after the
    last flush, or has priority 0; what is left at the end is the last batch.
    """
    timed = ops.withColumn("micros", order_value(ops, order[0]))
    needed = timed.select(*keys, *order, "priority", "micros")
    step = flush_step(config.start_size, config.flush_seconds * 1e6)
    marked = chained_fold(needed, keys, order, step, "ends_batch boolean", rows_per_task)
    marked = cut_lineage(marked.select(*keys, *order, "ends_batch"), "batches")  # fold once, read twice
    ended = F.col("ends_batch").cast("bigint")
    counted = Ordered(marked, keys, order, rows_per_task).running_sum("_done", ended).result()
    numbered = counted.select(*keys, *order, (F.col("_done") - ended + 1).alias("batch_no"))
    return ops.join(numbered, [*keys, *order])


def batch_order(batched: DataFrame, keys: Sequence[str] = ("server_id", "batch_no")) -> DataFrame:
    """Adds ``position`` within the batch: mutations, then deletions, each by priority and arrival.

    Batches hold at most ``max_size`` rows, so the window is bounded.
    """
    kind_rank = F.when(F.col("kind") == "Mutation", 0).otherwise(1)
    w = Window.partitionBy(*keys).orderBy(kind_rank, "priority", "seq")
    return batched.withColumn("position", F.row_number().over(w))


def combine_operations(df: DataFrame, payload: str = "json_data") -> DataFrame:
    """One row per JSON value: arrays are flattened one level, other values stay (``pos``, ``element``).

    Texts that are no JSON give no rows; ``malformed_operations`` returns them.
    """
    value = F.try_parse_json(F.col(payload))
    listed = F.when(
        F.expr("schema_of_variant(_v) like 'ARRAY%'"), F.col("_v").try_cast("array<variant>")
    ).otherwise(F.array("_v"))
    kept = [c for c in df.columns if c != payload]
    parsed = df.withColumn("_v", value).filter(F.col("_v").isNotNull())
    return parsed.select(*kept, F.posexplode(listed).alias("pos", "_e")).select(
        *kept, "pos", F.to_json("_e").alias("element")
    )


def malformed_operations(df: DataFrame, payload: str = "json_data") -> DataFrame:
    return df.filter(F.try_parse_json(F.col(payload)).isNull())


def retry_schedule(
    attempts: DataFrame, batch: Sequence[str], order: Sequence[str], config: BatchConfig = BatchConfig()
) -> DataFrame:
    """Attempts that take place per batch, numbered, with the delay before the next and final failure.

    Attempts end with the first success or the third try. Taking the first three per batch is a
    top-k that Spark applies before the shuffle.
    """
    w = Window.partitionBy(*batch).orderBy(*order)
    numbered = attempts.withColumn("attempt_no", F.row_number().over(w)).filter(
        F.col("attempt_no") <= config.max_retries
    )
    succeeded = F.max((~F.col("failed")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    made = numbered.withColumn("_done", F.coalesce(succeeded, F.lit(0))).filter(F.col("_done") == 0).drop("_done")
    again = F.col("failed") & (F.col("attempt_no") < config.max_retries)
    delay = F.pow(F.lit(2.0), F.col("attempt_no") - 1).cast("int") * config.base_delay_ms
    return made.withColumns(
        {
            "delay_ms": F.when(again, delay),
            "gave_up": F.col("failed") & (F.col("attempt_no") == config.max_retries),
        }
    )


def batch_stats(attempts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Successful and aborted attempts, items of the successful ones, success % (100 when none)."""
    ok = ~F.col("failed")
    count = lambda c: F.count_if(c)
    wins, losses = count(ok), count(F.col("failed"))
    rate = F.when(wins + losses == 0, 100.0).otherwise(wins / (wins + losses) * 100.0)
    return attempts.groupBy(*keys).agg(
        wins.alias("successful"),
        losses.alias("aborted"),
        count(ok & (F.col("kind") == "Mutation")).alias("mutations"),
        count(ok & (F.col("kind") == "Deletion")).alias("deletions"),
        count(ok).alias("total_items"),
        rate.alias("success_rate"),
    )


def next_batch_size(size: int, wins: float, losses: float, config: BatchConfig) -> int:
    total = wins + losses
    if total < config.settle_after:
        return size
    rate = wins / total * 100.0
    if rate < config.shrink_below and size > config.min_size:
        return max(size // 2, config.min_size)
    if rate > config.grow_above and size < config.max_size and wins % config.grow_every == 0:
        return min(size + config.grow_by, config.max_size)
    return size


def _changed_size(size: Column, change: Column, times: Column, config: BatchConfig) -> Column:
    """Size after ``times`` batches in a row that ask for a smaller (-1) or a larger (1) size."""
    halved = F.call_function("shiftright", size, F.least(times, F.lit(31)).cast("int"))
    smaller = F.when(size > config.min_size, F.greatest(halved, F.lit(config.min_size))).otherwise(size)
    grown = F.least(size + times * config.grow_by, F.lit(config.max_size)).cast("int")
    larger = F.when(size < config.max_size, grown).otherwise(size)
    return F.when(change < 0, smaller).when(change > 0, larger).otherwise(size)


def _sizes(config: BatchConfig) -> list[int]:
    """All sizes that can come of the first."""
    found, new = set(), {config.start_size}
    while new:
        found |= new
        smaller = {max(s // 2, config.min_size) for s in new if s > config.min_size}
        new = (smaller | {min(s + config.grow_by, config.max_size) for s in new if s < config.max_size}) - found
    return sorted(found)


def batch_size_controller(
    batches: DataFrame,
    keys: Sequence[str] = ("server_id",),
    order: Sequence[str] = ("batch_no",),
    config: BatchConfig = BatchConfig(),
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Batch size after each batch. ``batches``: keys, order, ``successes`` and ``aborts`` of the batch.

    The running totals are prefix sums. They say of each batch whether it asks for a smaller or a larger size. Wishes of one
    kind in a row are a run with one formula, so only the sizes that enter the runs need a fold. Between two turns the
    success rate has to pass from ``shrink_below`` to ``grow_above`` or back, so the runs of a key are as few as the logarithm
    of its attempts. Where the limits are set so that there are more, ranges of runs are maps of sizes (``ranges``).
    """
    given = cut_lineage(batches.select(*keys, *order, "successes", "aborts"), "batches")  # counted, then ordered
    total = F.col("wins") + F.col("losses")
    rate = F.col("wins") / total * 100.0
    more = (rate > config.grow_above) & (F.col("wins") % config.grow_every == 0)
    change = F.when(total < config.settle_after, 0).when(rate < config.shrink_below, -1).when(more, 1).otherwise(0)
    asked = (
        Ordered(given, keys, order, rows_per_task)
        .running_sum("wins", F.col("successes").cast("bigint"))
        .running_sum("losses", F.col("aborts").cast("bigint"))
        .running_sum("_downs", (change < 0).cast("bigint"))
        .running_sum("_ups", (change > 0).cast("bigint"))
        .last_known("_sign", F.when(change != 0, change))
        .result(*keys, *order, "wins", "losses", "_downs", "_ups", "_sign")
    )
    # within a run one of the counts stands still, and their sum numbers the wishes
    run = F.when(F.col("_sign") < 0, F.col("_ups")).when(F.col("_sign") > 0, F.col("_downs"))
    asked = cut_lineage(asked.withColumns({"_run": run, "_wish": F.col("_downs") + F.col("_ups")}).drop("_downs", "_ups"), "wishes")
    runs = asked.filter("_run is not null").groupBy(*keys, "_sign", "_run").agg(F.min("_wish").alias("_first"), F.max("_wish").alias("_last_wish"))
    runs = runs.withColumn("_times", F.col("_last_wish") - F.col("_first") + 1).drop("_last_wish")
    held = cut_lineage(ranges.in_ranges(ranges.numbered(cut_lineage(runs, "runs"), keys, ["_first"], rows_per_task), keys), "ranges")

    def step(size: Column, row: Column) -> Column:
        return _changed_size(size, row["_sign"], row["_times"], config)

    entering = ranges.entering_values(held, keys, _sizes(config), config.start_size, step)
    started = held.join(entering, [*keys, "_range"], "left").withColumn("entering", F.coalesce("entering", F.lit(config.start_size)))
    before = F.slice(ranges.states(F.col("rows"), F.col("entering"), step), F.lit(1), F.size("rows") - 1)
    sized = F.arrays_zip("rows", F.concat(F.array("entering"), before).alias("before"))
    opened = started.select(*keys, F.explode(sized).alias("r"))
    theirs = {k: f"_of_{k}" for k in keys}  # a null key meets itself
    opened = opened.select(*[F.col(k).alias(t) for k, t in theirs.items()], *[F.col(f"r.rows.{c}").alias(f"_of{c}") for c in ("_sign", "_run", "_first")], "r.before")
    same = [F.col(k).eqNullSafe(F.col(t)) for k, t in theirs.items()] + [F.col(c) == F.col(f"_of{c}") for c in ("_sign", "_run")]
    met = asked.join(opened, same, "left")
    size = _changed_size(F.col("before"), F.col("_sign"), F.col("_wish") - F.col("_of_first") + 1, config)
    return met.select(*keys, *order, "wins", "losses", F.coalesce(size, F.lit(config.start_size)).alias("batch_size"))
