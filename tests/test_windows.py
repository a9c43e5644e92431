"""Late rows of windows and sessions: kept apart, counted, and the same after a repeat."""

import random

import pytest
from pyspark.sql import functions as F

from worldstate.operators import telemetry
from worldstate.session import fresh_dir
from worldstate.streaming.sessions import player_sessions
from worldstate.streaming.windows import MetricsTable, SessionTable

SAMPLES = "server_id int, s double, memory double, numberobjects double, timefps double, currentplayers double"


def _at(rows, spark, schema):
    df = spark.createDataFrame(rows, schema).coalesce(2)
    return df.withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("bigint"))).drop("s")


def _split(batches, end, delay):
    """Rows in time and late, one batch after the other."""
    mark, on_time, late = None, [], []
    for rows in batches:
        for r in rows:
            is_late = r[1] is None or (mark is not None and end(r) <= mark)
            (late if is_late else on_time).append(r)
        known = [r[1] - delay for r in rows if r[1] is not None]
        mark = max([m for m in [mark, *known] if m is not None], default=None)
    return on_time, late


def _batches(rng, n, make):
    out = []
    for b in range(n):
        out.append([make(max(0, b * 100 + rng.choice([rng.randint(-300, 100), rng.randint(0, 100)]))) for _ in range(12)])
    out[2].append(make(None))
    return [*out[:3], [], *out[3:]]


def test_metrics_rows_in_are_rows_in_windows_and_late(spark):
    rng = random.Random(1)
    batches = _batches(rng, 6, lambda s: (rng.randrange(2), s if s is None else float(s), rng.choice([None, 2.0, 3.0]), 1.0, 60.0, float(rng.randrange(9))))
    table = MetricsTable(fresh_dir(spark, "m"), delay="90 seconds", fan=3)
    for i, rows in enumerate(batches):
        for _ in range(2):  # a repeated batch changes nothing
            table.write(_at(rows, spark, SAMPLES), i)
    on_time, late = _split(batches, lambda r: (r[1] // 60 + 1) * 60, 90)
    assert late and table.counts(spark)[:2] == (len(on_time) + len(late), len(late))
    assert table.late(spark).count() == len(late)
    want = telemetry.metrics_windows(_at(on_time, spark, SAMPLES)).collect()
    assert sorted(map(str, table.current(spark).select(*want[0].__fields__).collect())) == sorted(map(str, want))
    assert sum(r.samples for r in want) + len(late) == sum(map(len, batches))


@pytest.mark.parametrize("rows_per_task", [10**6, 5])
def test_sessions_grow_over_batches(spark, rows_per_task):
    rng, schema = random.Random(2), "entity_id bigint, s double, op string, seq bigint"
    batches = _batches(rng, 5, lambda s: (rng.randrange(3), s if s is None else float(s), rng.choice(["update", "update", "delete"]), rng.randrange(10**6)))
    table = SessionTable(fresh_dir(spark, "s"), "40 seconds", delay="60 seconds", rows_per_task=rows_per_task, fan=2)
    for i, rows in enumerate(batches):
        table.write(_at(rows, spark, schema), i)
    on_time, late = _split(batches, lambda r: r[1] + (1 if r[2] == "delete" else 40), 60)
    counts = table.counts(spark)
    assert late and counts[:2] == (sum(map(len, batches)), len(late)) and counts.watermark_us == (max(r[1] for b in batches for r in b if r[1] is not None) - 60) * 1e6
    want = player_sessions(_at(on_time, spark, schema), "40 seconds")
    got = table.current(spark).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.agg(F.sum("events")).first()[0] == len(on_time)


def test_empty_stream_and_failed_commit(spark, monkeypatch):
    table = MetricsTable(fresh_dir(spark, "m"))
    assert table.current(spark).count() == 0 and table.late(spark).count() == 0 and table.counts(spark) == (0, 0, None)
    rows = [(1, 1000.0, 1.0, 1.0, 1.0, 1.0)]
    table.write(_at(rows, spark, SAMPLES), 0)
    late = _at([(1, 10.0, 1.0, 1.0, 1.0, 1.0)], spark, SAMPLES)
    with monkeypatch.context() as patch:
        patch.setattr(table.log, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.write(late, 1)
    assert table.counts(spark)[:2] == (1, 0) and table.late(spark).count() == 0
    table.write(late, 1)
    assert table.counts(spark)[:2] == (2, 1) and table.late(spark).count() == 1
