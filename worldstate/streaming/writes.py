"""Batched writes from a stream: batches, delivery with retries, adaptive size and idle flush, all as keyed state.

The state of a server holds the buffer (at most ``max_size`` operations), the number of the next batch, the time of
the last flush, the attempts so far and the size they lead to. A batch leaves when it is full, holds an operation of priority 0, an operation comes later than the flush time, or the
flush time passes without one: then a timer of the watermark flushes it, and an operation that comes first finds
the batch flushed just as the timer would have done.

Commit protocol: a batch is delivered under its key (server, ``batch_no``), up to three times, with the delay
doubling in between; its neighbours are not repeated. The batches of a server go out one after the other, but servers
do not wait for one another: they are dealt to lanes, a lane is one call of the processor, and while a server of the
lane waits for its next try the others go on (in one thread, since threads that wake from short waits stand in line
for the interpreter). The outcome row goes to the log with the micro-batch, the
state with the checkpoint. If a micro-batch is repeated after a failure the same batches come again under the same
keys, so ``deliver`` must replace what it has stored under a key. A batch given up after the last try stays in the
log with its operations, and the next batches go on, sized by the attempts so far.
"""

from __future__ import annotations

import heapq
import json
import pickle
import time
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Generator, Iterable, Iterator, Sequence
from itertools import islice
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from worldstate.operators.batching import BatchConfig, flush_step, next_batch_size
from worldstate.operators.ordered import order_value
from worldstate.streaming.folds import KEY, stream_fold, use_rocksdb
from worldstate.streaming.state_table import UNTIL_READ

OUTCOME = (
    "batch_no bigint, batch_size int, items int, mutations int, deletions int, cause string, flushed_at timestamp, "
    "attempts int, delays_ms array<int>, delivered boolean, error string, next_size int, seqs array<bigint>"
)

LANE = "write_lane"
# Numbers that Spark's hash leaves 0 to 7 modulo 201,600: lanes meet in no task if the shuffle partitions divide that (8, 12, 24, 200, …)
LANES = (300825, 1168430, 186704, 113617, 346953, 13468, 31498, 120585)
TOGETHER = 64  # servers of a lane that are under way at a time
ROWS = 1_000  # operations of a server that are made Python objects at a time
OUTCOMES = 10_000  # outcomes of a lane handed on at a time
WHOLE = {"tinyint", "smallint", "int", "bigint", "boolean", "string"}  # key types that JSON keeps as they are

Row = dict[str, Any]
Waits = Generator[float, None, Any]  # yields the seconds to wait before it goes on
Deliver = Callable[[tuple, int, int, list[Row]], None]  # key, batch_no, attempt, operations in order; raises to refuse


class Buffer(NamedTuple):
    """State of one server."""

    last: float  # last flush, in microseconds
    size: int
    batch_no: int = 1
    wins: int = 0
    losses: int = 0
    held: tuple[Row, ...] = ()
    timer: int | None = None


def accept(key: tuple, batch_no: int, attempt: int, rows: list[Row]) -> None:
    """Takes every batch: the log is the store."""


def alone(work: Waits, pause=time.sleep) -> Any:
    """Runs ``work`` with its waits; what it returns."""
    while True:
        try:
            wait = next(work)
        except StopIteration as done:
            return done.value
        pause(wait)


def side_by_side(works: Iterable[Waits], together: int = TOGETHER) -> Iterator[None]:
    """Runs works in turn, by the time each may go on; sleeps only when all wait. Comes back after each step."""
    rest = enumerate(works)
    ready = [(0.0, i, work) for i, work in islice(rest, together)]
    while ready:
        at, i, work = ready[0]
        early = at - time.monotonic()
        if early > 0:
            time.sleep(early)
        try:
            wait = next(work)
        except StopIteration:
            heapq.heappop(ready)
            for j, following in islice(rest, 1):
                heapq.heappush(ready, (0.0, j, following))
        else:
            heapq.heapreplace(ready, (time.monotonic() + wait, i, work))
        yield


def tries(buffer: Buffer, key: tuple, cause: str, at: float, deliver: Deliver, config: BatchConfig) -> Waits:
    """Delivers what is held: mutations, then deletions, each by priority and arrival. The buffer after it, and the outcome."""
    rows = sorted(buffer.held, key=lambda r: (r["kind"] != "Mutation", r["priority"], r["seq"]))
    wins, losses, delays, error, delivered = buffer.wins, buffer.losses, [], None, False
    for attempt in range(1, config.max_retries + 1):
        try:
            deliver(key, buffer.batch_no, attempt, rows)
        except Exception as refused:
            losses, error = losses + 1, str(refused)[:500]
            if attempt < config.max_retries:
                delays.append(config.base_delay_ms << (attempt - 1))
                yield delays[-1] / 1000
        else:
            wins, delivered = wins + 1, True
            break
    size = next_batch_size(buffer.size, wins, losses, config)
    mutations = [r["kind"] for r in rows].count("Mutation")
    outcome = {
        "batch_no": buffer.batch_no, "batch_size": buffer.size, "items": len(rows), "mutations": mutations, "deletions": len(rows) - mutations,
        "cause": cause, "flushed_at": pd.Timestamp(int(at), unit="us"), "attempts": attempt, "delays_ms": delays, "delivered": delivered,
        "error": error, "next_size": size, "seqs": [int(r["seq"]) for r in rows],
    }
    return Buffer(at, size, buffer.batch_no + 1, wins, losses, (), buffer.timer), outcome


def commit(buffer: Buffer, key: tuple, cause: str, at: float, deliver: Deliver, config: BatchConfig, pause=time.sleep) -> tuple[Buffer, Row]:
    """``tries`` of one server alone."""
    return alone(tries(buffer, key, cause, at, deliver, config), pause)


def taking(buffer: Buffer, rows: list[Row], micros: np.ndarray, flush: Callable[[Buffer, str, float], Waits], wait: float) -> Waits:
    """Adds operations in order; ``flush`` is called wherever a batch ends. The buffer after them."""
    urgent = [i for i, r in enumerate(rows) if r["priority"] == 0]
    times = np.where(np.isnan(micros), np.inf, micros).tolist()
    i, n, next_urgent = 0, len(rows), 0
    while i < n:
        late = bisect_right(times, buffer.last + wait, i)
        next_urgent = bisect_right(urgent, i - 1, next_urgent)
        hit = urgent[next_urgent] if next_urgent < len(urgent) else n
        full = i + max(0, buffer.size - len(buffer.held) - 1)
        end = min(full, hit, n)
        if late <= end and late < n:
            if buffer.held or late > i:  # the flush time passes before that operation comes
                buffer = yield from flush(buffer._replace(held=(*buffer.held, *rows[i:late])), "idle", buffer.last + wait)
                i = late
            else:
                buffer = yield from flush(buffer._replace(held=(rows[i],)), "late", times[i])
                i += 1
        elif end < n:
            cause = "priority" if hit == end else "size"
            buffer = yield from flush(buffer._replace(held=(*buffer.held, *rows[i : end + 1])), cause, times[end])
            i = end + 1
        else:
            buffer, i = buffer._replace(held=(*buffer.held, *rows[i:])), n
    return buffer


def take(buffer: Buffer, rows: list[Row], micros: np.ndarray, flush: Callable[[Buffer, str, float], Buffer], wait: float) -> Buffer:
    """``taking`` of one server alone, with a ``flush`` that waits itself."""

    def waited(held: Buffer, cause: str, at: float) -> Waits:
        yield from ()
        return flush(held, cause, at)

    return alone(taking(buffer, rows, micros, waited, wait))


class WriteProcessor(StatefulProcessor):
    """One call takes the operations of all servers of a lane; the rows of a lane in one micro-batch are sorted in memory.

    A timer stands for all servers of the lane that are due then; one whose buffer has left in the meantime is passed over.
    """

    def __init__(self, keys: Sequence[str], deliver: Deliver, config: BatchConfig, whole: Sequence[str] = ()):
        self._keys, self._deliver, self._config, self._whole = list(keys), deliver, config, set(whole)
        self._wait = config.flush_seconds * 1e6

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._buffers = handle.getMapState("buffers", "name string", "value binary")
        self._due = handle.getMapState("due", "at bigint", "names string")

    def _outcomes(self, outcomes: list[Row]) -> pd.DataFrame:
        """Keys as objects: a missing one would make floats of the others."""
        return pd.DataFrame(outcomes).assign(**{k: pd.Series([o[k] for o in outcomes], dtype=object) for k in self._keys})

    def _run(self, works: Iterable[tuple[str, tuple, Buffer, Callable[[Buffer, Callable], Waits]]]) -> Iterator[pd.DataFrame]:
        """``works``: name and key of a server, its buffer, and what to do with it."""
        outcomes: list[Row] = []
        due: dict[int, list[str]] = defaultdict(list)

        def run(name: str, key: tuple, buffer: Buffer, work: Callable[[Buffer, Callable], Waits]) -> Waits:
            named = dict(zip(self._keys, key))

            def flush(held: Buffer, cause: str, at: float) -> Waits:
                after, outcome = yield from tries(held, key, cause, float(at), self._deliver, self._config)
                outcomes.append(named | outcome)
                yield 0.0  # the turn of those whose wait is over
                return after

            buffer = yield from work(buffer, flush)
            at = int((buffer.last + self._wait) // 1000) + 1 if buffer.held else None
            if at is not None and at != buffer.timer:
                due[at].append(name)
            self._buffers.updateValue((name,), (pickle.dumps((key, *buffer._replace(timer=at))),))

        for _ in side_by_side(run(*work) for work in works):
            if len(outcomes) >= OUTCOMES:
                yield self._outcomes(outcomes)
                outcomes.clear()
        for at, names in due.items():
            others = self._due.getValue((at,))
            if others is None:
                self._handle.registerTimer(at)
            self._due.updateValue((at,), (json.dumps(names + (json.loads(others[0]) if others else [])),))
        if outcomes:
            yield self._outcomes(outcomes)

    def _held(self, name: str) -> tuple[tuple, Buffer] | None:
        found = self._buffers.getValue((name,))
        if found is None:
            return None
        key, *fields = pickle.loads(found[0])
        return key, Buffer(*fields)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunks = [pdf.drop(columns=[LANE]) for pdf in rows if not pdf.empty]
        if not chunks:
            return
        pdf = pd.concat(chunks, ignore_index=True)
        chunks.clear()
        codes, names = pd.factorize(pdf[KEY])
        pdf = pdf.assign(**{KEY: codes}).sort_values([KEY, "micros", "seq"], kind="stable", ignore_index=True)
        borders = np.searchsorted(pdf[KEY].to_numpy(), np.arange(len(names) + 1))
        micros = pdf["micros"].to_numpy("float64")
        pdf = pdf.drop(columns=[KEY, "micros"])

        def new(name: str, first: pd.Series) -> tuple:
            given = json.loads(name)  # without missing values
            return tuple(given.get(k) if k in self._whole or k not in given else first[k] for k in self._keys)

        def works():
            for name, start, end in zip(names, borders[:-1], borders[1:]):
                server, buffer = self._held(name) or (new(name, pdf.iloc[start]), Buffer(float(micros[start]), self._config.start_size))

                def work(buffer: Buffer, flush, start=start, end=end, known=dict(zip(self._keys, server))) -> Waits:
                    for a in range(start, end, ROWS):
                        b = min(a + ROWS, end)
                        columns = [[known[c]] * (b - a) if c in known else pdf[c].iloc[a:b].tolist() for c in pdf.columns]
                        listed = [dict(zip(pdf.columns, values)) for values in zip(*columns)]
                        buffer = yield from taking(buffer, listed, micros[a:b], flush, self._wait)
                    return buffer

                yield name, server, buffer, work

        yield from self._run(works())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The first timer that expires takes the servers of all others that have, too."""
        if not self._due.containsKey((expiredTimerInfo.getExpiryTimeInMs(),)):
            return
        newest = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        over = sorted(at for (at,) in self._due.keys() if at <= newest)

        def works():
            for at in over:
                for name in json.loads(self._due.getValue((at,))[0]):
                    server, buffer = self._held(name)
                    if buffer.timer == at:
                        yield name, server, buffer, lambda b, flush: flush(b._replace(timer=None), "idle", b.last + self._wait)
                self._due.removeKey((at,))

        yield from self._run(works())

    def close(self) -> None:
        pass


def batch_outcomes(
    ops: DataFrame, deliver: Deliver = accept, config: BatchConfig = BatchConfig(), keys: Sequence[str] = ("server_id",), at: str = "ts", delay: str = "1 minute",
    lanes: Sequence[int] = LANES,
) -> DataFrame:
    """Delivers a stream of operations in batches; a stream of one outcome row per batch (``OUTCOME``).

    ``ops`` has the keys, the event time ``at``, ``seq``, ``priority``, ``kind`` and what ``deliver`` needs. Operations
    later than ``delay`` behind the newest are dropped by the watermark. Servers are dealt to ``lanes`` by their hash;
    the lanes must stay the same for a checkpoint.
    """
    use_rocksdb(ops.sparkSession)
    timed = ops.withColumn("micros", order_value(ops, at)).withWatermark(at, delay)
    kinds = dict(timed.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + OUTCOME
    named = timed.withColumn(KEY, F.to_json(F.struct(*keys)))
    lane = F.pmod(F.xxhash64(KEY), F.lit(len(lanes))).cast("int")
    dealt = named.withColumn(LANE, F.element_at(F.array(*[F.lit(n) for n in lanes]), lane + 1))
    processor = WriteProcessor(keys, deliver, config, [k for k in keys if kinds[k] in WHOLE])
    return dealt.groupBy(LANE).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )


class OutcomeLog:
    """Outcomes as a table, one folder per micro-batch; a repeated micro-batch replaces its own."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, outcomes: DataFrame, micro_batch: int) -> None:
        outcomes.write.mode("overwrite").parquet(f"{self.path}/micro={micro_batch}")

    def batches(self, spark: SparkSession) -> DataFrame:
        return spark.read.option("basePath", self.path).parquet(self.path)

    def sizes(self, spark: SparkSession, keys: Sequence[str] = ("server_id",)) -> DataFrame:
        """The size in force per server: what its last batch led to."""
        return self.batches(spark).groupBy(*keys).agg(F.max_by("next_size", "batch_no").alias("batch_size"))


def write_batches(
    ops: DataFrame, log: OutcomeLog, checkpoint: str, deliver: Deliver = accept, config: BatchConfig = BatchConfig(), delay: str = "1 minute", **trigger
) -> StreamingQuery:
    """Streams operations (server_id, ts, seq, priority, kind, …) through ``deliver``, outcomes into ``log``."""
    return (
        batch_outcomes(ops, deliver, config, delay=delay).writeStream.foreachBatch(log)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or UNTIL_READ))
        .start()
    )


def assign_stream(ops: DataFrame, config: BatchConfig = BatchConfig()) -> DataFrame:
    """Stream twin of ``batch_assign``: marks the operations that end a batch.

    ``ops`` carries ``micros``, the arrival time in microseconds. An operation can only be marked when it comes, so
    there is no idle flush here; ``batch_outcomes`` has it.
    """
    step = flush_step(config.start_size, config.flush_seconds * 1e6)
    return stream_fold(ops, ["server_id"], ["ts", "seq"], step, "ends_batch boolean")
