"""Latched overload alerts and the in-transfer set, for table and stream."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from worldstate.operators.ordered import ROWS_PER_TASK, Ordered
from worldstate.operators.zones import MAX_PLAYERS
from worldstate.session import cut_lineage
from worldstate.streaming.folds import stream_fold, use_rocksdb


def _latch_step(max_players: int):
    def run(latched, rows):
        latched = bool(latched)
        alerts = np.zeros(len(rows), dtype=bool)
        for i, (kind, players) in enumerate(zip(rows["kind"].tolist(), rows["players"].tolist())):
            if kind == "zone_changed":
                latched = False
            elif players > max_players and not latched:
                latched = alerts[i] = True
        return latched, {"alert": alerts}

    return run


def overload_alerts(
    events: DataFrame, max_players: int = MAX_PLAYERS, order=("ts", "seq"), rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """One alert per overload: the first too-high count after each completed zone change.

    ``events``: server_id, order columns, kind (population or zone_changed), players. Works on a
    stream or a table.
    """
    if events.isStreaming:
        marked = stream_fold(events, ["server_id"], order, _latch_step(max_players), "alert boolean")
        return marked.filter("alert").drop("alert", "kind")
    changed = F.when(F.col("kind") == "zone_changed", 1).otherwise(0)
    rows = Ordered(events, ["server_id"], order, rows_per_task).running_sum("_change", changed).result()
    high = rows.filter((F.col("kind") != "zone_changed") & (F.col("players") > max_players))
    kept = [c for c in events.columns if c != "kind"]
    first = high.groupBy("server_id", "_change").agg(F.min_by(F.struct(*kept), F.struct(*order)).alias("_first"))
    return first.select("_first.*")


OPENS, CLOSES = ("plan",), ("remote_update", "arrive")


def _openings(plans: DataFrame, keys: list[str], timeout_us: float, rows_per_task: int) -> DataFrame:
    """``keys, _round, _at (position)`` of the plans that open a transfer.

    A round of plans without a close between them begins with an opening; from there on each opening is the first
    plan later than the timeout of the one before. Rounds that are over before the timeout need no more. In the
    others every plan points at the one it would hand over to, found by one merge of plans and their deadlines, and
    the chain of pointers is followed by doubling: reached plans jump 1, 2, 4, … hand-overs, so rounds of work grow
    with the logarithm of the longest chain.
    """
    spans = plans.groupBy(*keys, "_round").agg(F.min_by(F.struct("_at", "micros"), "_at").alias("first"), F.max("micros").alias("until"))
    firsts = spans.select(*keys, "_round", F.col("first._at").alias("_at"))
    long = spans.filter(F.col("until") > F.col("first.micros") + timeout_us).select(*keys, "_round")
    chained = plans.join(long, [*keys, "_round"], "left_semi")
    # a plan's deadline sorts behind plans of the same time, so the next plan after it is later than the timeout
    marks = chained.select(*keys, "_round", "_at", F.explode(F.array(F.struct(F.col("micros").alias("m"), F.lit(0).alias("mark")), F.struct((F.col("micros") + timeout_us).alias("m"), F.lit(1).alias("mark")))).alias("k"))
    marks = marks.select(*keys, "_round", "_at", "k.m", "k.mark")
    scan = Ordered(marks, [*keys, "_round"], ["m", "mark", "_at"], rows_per_task).next_known("_next", F.when(F.col("mark") == 0, F.col("_at"))).result()
    jumps = cut_lineage(scan.filter("mark = 1 and _next is not null").select(*keys, "_round", "_at", "_next"), "jumps")
    reached = cut_lineage(firsts, "openings")
    while not jumps.isEmpty():
        there = reached.join(jumps, [*keys, "_round", "_at"]).select(*keys, "_round", F.col("_next").alias("_at"))
        reached = cut_lineage(reached.union(there).distinct(), "openings")
        twice = jumps.alias("a").join(jumps.select(*keys, "_round", F.col("_at").alias("_next"), F.col("_next").alias("_then")), [*keys, "_round", "_next"])
        jumps = cut_lineage(twice.select(*keys, "_round", "_at", F.col("_then").alias("_next")), "jumps")
    return reached


def transfer_tracker(
    events: DataFrame,
    order=("ts", "seq"),
    timeout_s: float = 10 * 365 * 86400.0,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """What each event does to a player's transfer: action and ``in_transfer`` after it.

    Events: plan opens; remote_update and arrive close; a disconnect deletes the player unless in
    transfer. A transfer older than ``timeout_s`` expires: on a table at the player's next event, whose action says
    so unless it does something itself. ``events``: entity_id, order columns, ``micros`` (event time in microseconds,
    never falling in the order), event.

    A close ends whatever is open, so closes cut a player's events into rounds, and within a round plans open by
    the clock alone (``_openings``). What is open at an event is then the last opening of its round: scans and
    joins, no fold. On a stream see ``TransferProcessor``.
    """
    if events.isStreaming:
        return transfer_stream(events, order, timeout_s)
    keys, timeout_us = ["entity_id"], timeout_s * 1e6
    close = F.col("event").isin(*CLOSES)
    rounds = Ordered(events, keys, order, rows_per_task).row_number("_at").running_sum("_closes", close.cast("bigint")).result()
    # a close still belongs to the round it ends
    rounds = cut_lineage(rounds.withColumn("_round", F.col("_closes") - close.cast("bigint")).drop("_closes"), "rounds")
    plans = rounds.filter(F.col("event").isin(*OPENS)).select(*keys, "_round", "_at", "micros")
    openings = _openings(plans, keys, timeout_us, rows_per_task).withColumn("_opens", F.lit(True))
    marked = rounds.join(openings, [*keys, "_round", "_at"], "left")
    opened = F.when(F.col("_opens"), F.struct(F.col("micros").alias("micros"), F.col("_round").alias("round")))
    before = F.struct("_open", "micros")
    scan = Ordered(marked, keys, order, rows_per_task).last_known("_open", opened).lag("_before", before).result()
    # open before this event: the last opening at the row before, if of this round and not expired by then
    at = F.when(F.col("_before._open.round") == F.col("_round"), F.col("_before._open.micros"))
    held = at.isNotNull() & (F.col("_before.micros") - at <= timeout_us)
    expired = held & (F.col("micros") - at > timeout_us)
    still = F.coalesce(held & ~expired, F.lit(False))
    opens = F.coalesce("_opens", F.lit(False))
    action = (
        F.when(opens, "open").when(close & still, "close").when((F.col("event") == "disconnect") & ~still, "delete")
        .when(F.coalesce(expired, F.lit(False)), "expire").otherwise("none")
    )
    inside = opens | (still & ~close)
    return scan.select(*events.columns, action.alias("action"), inside.alias("in_transfer"))


class TransferProcessor(StatefulProcessor):
    """A player's open transfer, with a timer that expires it when the watermark passes its timeout.

    Whether the timer or a later event of the player comes first, the transfer expires at its timeout: a row of its own,
    action ``expire``, with the time of the timeout and no event. An event that comes first finds it expired.
    """

    def __init__(self, columns: list[str], order: list[str], timeout_s: float):
        self._columns, self._order, self._timeout = columns, order, timeout_s * 1e6

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("opened", "micros double, timer bigint")

    def _expiry(self, key: tuple, opened: float) -> dict:
        row = dict.fromkeys(self._columns)
        return row | {"entity_id": key[0], "micros": opened + self._timeout, "action": "expire", "in_transfer": False}

    def handleInputRows(self, key, rows, timerValues):
        chunks = [pdf for pdf in rows if not pdf.empty]
        if not chunks:
            return
        pdf = pd.concat(chunks).sort_values(self._order, kind="stable", ignore_index=True)
        opened, timer = self._state.get() if self._state.exists() else (None, None)
        out = []
        for row in pdf.to_dict("records"):
            if opened is not None and row["micros"] - opened > self._timeout:
                out.append(self._expiry(key, opened))
                opened = None
            action, event = "none", row["event"]
            if event in OPENS and opened is None:
                opened, action = float(row["micros"]), "open"
            elif event in CLOSES and opened is not None:
                opened, action = None, "close"
            elif event == "disconnect" and opened is None:
                action = "delete"
            out.append(row | {"action": action, "in_transfer": opened is not None})
        due = None if opened is None else int((opened + self._timeout) // 1000) + 1
        if due != timer:
            if timer is not None:
                self._handle.deleteTimer(timer)
            if due is not None:
                self._handle.registerTimer(due)
        self._keep(opened, due)
        yield pd.DataFrame(out, columns=self._columns)

    def _keep(self, opened: float | None, timer: int | None) -> None:
        if opened is None:
            self._state.clear()
        else:
            self._state.update((opened, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self._state.exists():
            return
        opened, timer = self._state.get()
        if timer is not None and expiredTimerInfo.getExpiryTimeInMs() >= timer:
            self._keep(None, None)
            yield pd.DataFrame([self._expiry(key, opened)], columns=self._columns)

    def close(self) -> None:
        pass


def transfer_stream(events: DataFrame, order=("ts", "seq"), timeout_s: float = 10 * 365 * 86400.0, delay: str = "10 minutes") -> DataFrame:
    """Stream form of ``transfer_tracker``: expiries are rows of their own, also when no event of the player follows.

    ``events`` also has the event time ``ts``; rows later than ``delay`` are dropped by the watermark.
    """
    use_rocksdb(events.sparkSession)
    columns = [*events.columns, "action", "in_transfer"]
    schema = ", ".join(f"`{c}` {t}" for c, t in events.dtypes) + ", action string, in_transfer boolean"
    return events.withWatermark("ts", delay).groupBy("entity_id").transformWithStateInPandas(
        statefulProcessor=TransferProcessor(columns, list(order), timeout_s), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )
