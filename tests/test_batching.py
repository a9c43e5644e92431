"""Batching rule, retries and size controller against straightforward loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from worldstate.operators import batching, ranges
from worldstate.operators.batching import BatchConfig

SMALL = BatchConfig(start_size=7, flush_seconds=2.0)


def _loop(rows, config):
    """The rule, one operation at a time."""
    out, batch, held, last = [], 1, 0, rows[0][0]
    for t, _, priority in rows:
        held += 1
        out.append(batch)
        if held >= config.start_size or t - last > config.flush_seconds * 1e6 or priority == 0:
            batch, held, last = batch + 1, 0, t
    return out


@pytest.mark.parametrize("rows_per_task", [10**6, 60, 11])
def test_batches_equal_the_loop(spark, rows_per_task):
    rng = random.Random(4)
    rows = []
    for server, n in ((1, 400), (2, 60), (3, 1)):
        t = 0
        for i in range(n):
            t += rng.choice([0, 1000, 200_000, 900_000, 2_000_000, 3_000_000])
            rows.append((server, t, server * 1000 + i, rng.choice([0] + [5] * 15), "Mutation"))
    df = spark.createDataFrame(rows, "server_id int, us bigint, seq int, priority int, kind string")
    df = df.withColumn("ts", F.timestamp_micros("us"))
    got = batching.batch_assign(df, config=SMALL, rows_per_task=rows_per_task).collect()
    assert len(got) == len(rows)
    for server in (1, 2, 3):
        mine = sorted((r["us"], r["seq"], r["priority"], r["batch_no"]) for r in got if r["server_id"] == server)
        assert [m[3] for m in mine] == _loop([m[:3] for m in mine], SMALL)


def test_order_within_a_batch(spark):
    rows = [(1, 1, 1, "Deletion", 0), (1, 1, 2, "Mutation", 5), (1, 1, 3, "Mutation", 2), (1, 1, 4, "Mutation", 5), (1, 1, 5, "Deletion", 0)]
    df = spark.createDataFrame(rows, "server_id int, batch_no int, seq int, kind string, priority int")
    got = batching.batch_order(df).orderBy("position").collect()
    assert [r["seq"] for r in got] == [3, 2, 4, 1, 5]


def test_payloads_are_flattened_one_level(spark):
    rows = [(1, '{"a":1}'), (2, '[{"a":2},[3],4]'), (3, "[]"), (4, "{broken"), (5, "7")]
    df = spark.createDataFrame(rows, "seq int, json_data string")
    got = batching.combine_operations(df).orderBy("seq", "pos").collect()
    assert [(r["seq"], r["pos"], r["element"]) for r in got] == [
        (1, 0, '{"a":1}'), (2, 0, '{"a":2}'), (2, 1, "[3]"), (2, 2, "4"), (5, 0, "7"),
    ]
    assert [r["seq"] for r in batching.malformed_operations(df).collect()] == [4]


def test_retries_double_the_delay_and_give_up_after_three(spark):
    logs = {1: [True, True, True, False], 2: [True, False, True], 3: [False]}
    rows = [(b, i, f) for b, log in logs.items() for i, f in enumerate(log)]
    df = spark.createDataFrame(rows, "batch_no int, seq int, failed boolean")
    got = batching.retry_schedule(df, ["batch_no"], ["seq"]).orderBy("batch_no", "attempt_no").collect()
    assert [(r["batch_no"], r["attempt_no"], r["delay_ms"], r["gave_up"]) for r in got] == [
        (1, 1, 50, False), (1, 2, 100, False), (1, 3, None, True), (2, 1, 50, False), (2, 2, None, False), (3, 1, None, False),
    ]


def test_stats_without_attempts(spark):
    none = spark.createDataFrame([], "failed boolean, kind string")
    row = batching.batch_stats(none).first()
    assert (row["successful"], row["aborted"], row["success_rate"]) == (0, 0, 100.0)


@pytest.mark.parametrize("rows_per_task", [10**6, 25])
def test_size_controller_grows_and_shrinks(spark, rows_per_task):
    log = [(1, i, 1, 0) for i in range(120)] + [(2, i, 1, 2) for i in range(90)] + [(3, i, 1, i % 2) for i in range(30)]
    df = spark.createDataFrame(log, "server_id int, batch_no int, successes int, aborts int")
    got = batching.batch_size_controller(df, rows_per_task=rows_per_task).orderBy("server_id", "batch_no").collect()
    config = BatchConfig()
    for server in (1, 2, 3):
        size, wins, losses, want = config.start_size, 0, 0, []
        for _, _, s, a in (r for r in log if r[0] == server):
            wins, losses = wins + s, losses + a
            rate = wins / (wins + losses) * 100
            if wins + losses >= 10:
                if rate < 80 and size > 20:
                    size = max(size // 2, 20)
                elif rate > 95 and size < 1000 and wins % 20 == 0:
                    size = min(size + 50, 1000)
            want.append(size)
        assert [r["batch_size"] for r in got if r["server_id"] == server] == want
    last = {r["server_id"]: r["batch_size"] for r in got}
    assert last[1] == 500 and last[2] == 20


@pytest.mark.parametrize("limits", [(80.0, 95.0), (50.0, 50.0)])
def test_size_controller_folds_runs_of_wishes_not_batches(spark, limits, monkeypatch):
    """The fold sees one row per turn of the wishes; also with limits that let every batch turn."""
    config = BatchConfig(shrink_below=limits[0], grow_above=limits[1], grow_every=1, grow_by=30)
    rng = np.random.default_rng(7)
    log = [(k, i, int(rng.integers(0, 2)), int(rng.integers(0, 2))) for k in (1, 2) for i in range(700)]
    log += [(3, i, *((1, 0) if i < 40 or 60 < i < 900 else (0, 1))) for i in range(1200)]
    df = spark.createDataFrame(log, "server_id int, batch_no int, successes int, aborts int")
    folded, in_ranges = [], ranges.in_ranges

    def counted(rows, keys):
        folded.append(rows.count())
        return in_ranges(rows, keys)

    monkeypatch.setattr(ranges, "in_ranges", counted)
    got = batching.batch_size_controller(df, config=config).orderBy("server_id", "batch_no").collect()
    want, turns = [], 0
    for server in (1, 2, 3):
        size, wins, losses, last = config.start_size, 0, 0, 0
        for _, _, s, a in (r for r in log if r[0] == server):
            wins, losses = wins + s, losses + a
            size = batching.next_batch_size(size, wins, losses, config)
            rate = wins / (wins + losses) * 100 if wins + losses >= config.settle_after else None
            wish = 0 if rate is None else -1 if rate < config.shrink_below else int(rate > config.grow_above)
            turns += wish not in (0, last)
            last = wish or last
            want.append((server, wins, losses, size))
    assert [(r["server_id"], r["wins"], r["losses"], r["batch_size"]) for r in got] == want
    assert folded == [turns]
