"""Feeds: parsing, paging, deltas, snapshots, as-of values."""

import json

import random

import pytest
from pyspark.sql import functions as F

from worldstate.plans import QUERIES
from worldstate.operators import feeds, membership
from worldstate.streaming.sessions import player_sessions, player_sessions_stream

ENTITY = "client_uuid string, x string, y double"


def test_parse_reads_numbers_with_and_without_fraction_and_text(spark):
    log = [
        (1, '{"add":[{"client_uuid":"a","x":"1.5","y":2}],"update":[],"delete":[],"server_id":1.0}'),
        (2, '{"update":[{"client_uuid":"a","x":"2","y":3.5},{"client_uuid":"b"}],"server_id":2}'),
        (3, '{"delete":[{"client_uuid":"a"}],"add":null,"server_id":1}'),
        (4, "not an envelope"),
    ]
    df = spark.createDataFrame(log, "seq int, payload string")
    rows = [tuple(r) for r in feeds.parse_change_feed(df, ENTITY).orderBy("seq", "pos").collect()]
    assert rows == [
        (1, 1, "add", 0, "a", "1.5", 2.0),
        (2, 2, "update", 0, "a", "2", 3.5),
        (2, 2, "update", 1, "b", None, None),
        (3, 1, "delete", 0, "a", None, None),
    ]
    assert [r["seq"] for r in feeds.rejected_envelopes(df).collect()] == [4]


@pytest.mark.parametrize("rows_per_task", [10**6, 20])
def test_published_parts_hold_every_row_once(spark, rows_per_task):
    rows = [(s, 0, i, ("add", "update", "delete")[i % 3], float(i)) for s, n in ((1, 95), (2, 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "server_id int, tick int, seq int, op string, x double")
    out = feeds.publish_change_feed(df, "tick", ["seq"], ["seq", "x"], max_entities=10, rows_per_task=rows_per_task)
    parts = out.orderBy("server_id", "part").collect()
    assert [r["server_id"] for r in parts] == [1] * 10 + [2]
    assert all(r["n_add"] + r["n_update"] + r["n_delete"] <= 10 for r in parts)
    seen = [e["seq"] for r in parts if r["server_id"] == 1 for op in feeds.OPS for e in json.loads(r["payload"])[op]]
    assert sorted(seen) == list(range(95))
    first = json.loads(parts[0]["payload"])
    assert [e["seq"] for e in first["add"]] == [0, 3, 6, 9] and first["server_id"] == 1


def test_moved_since_last_compares_with_zero_first(spark):
    rows = [(1, 0, 0.0), (1, 1, 0.0), (1, 2, 5.0), (1, 3, 5.0), (2, 0, 1.0), (3, 0, 9.0), (4, 0, None), (4, 1, None)]
    df = spark.createDataFrame(rows, "k int, seq int, x double")
    transfer = spark.createDataFrame([(3,)], "k int")
    got = feeds.moved_since_last(df, ["k"], ["seq"], ["x"], transfer).collect()
    assert sorted((r["k"], r["seq"]) for r in got) == [(1, 2), (2, 0), (4, 0)]


def test_tick_sample_keeps_the_latest_of_a_period(spark):
    df = spark.sql("select 1 as k, id as seq, timestamp_millis(id * 100) as ts from range(20)")
    got = feeds.tick_sample(df, ["k"], ["ts", "seq"], feeds.PLAYER_TICKS)
    assert sorted(r["seq"] for r in got.collect()) == [5, 10, 15, 19]  # 16 ticks at 30 per second = 533 ms


def test_latest_state_drops_deleted_and_revives(spark):
    rows = [("a", 1, "add"), ("a", 2, "delete"), ("b", 1, "update"), ("c", 1, "delete"), ("c", 2, "add"), ("d", 1, "delete")]
    df = spark.createDataFrame(rows, "k string, seq int, op string")
    assert {r["k"] for r in feeds.latest_state(df, ["k"], ["seq"]).collect()} == {"b", "c"}


def test_partial_updates_keep_other_fields_until_a_delete(spark):
    rows = [
        (1, 1, "add", "one", 1.0), (1, 2, "update", None, 2.0), (2, 1, "add", "two", 1.0), (2, 2, "delete", None, None),
        (2, 3, "update", None, 7.0), (3, 1, "add", "x", 0.0), (3, 2, "delete", None, None),
    ]
    df = spark.createDataFrame(rows, "id int, seq int, op string, name string, x double")
    got = feeds.merge_partial_updates(df, ["id"], ["seq"], ["name", "x"])
    assert {tuple(r) for r in got.collect()} == {(1, "one", 2.0), (2, None, 7.0)}


def test_snapshot_is_older_than_every_change(spark):
    snap = spark.createDataFrame([(1, 99, "add", "s"), (2, 99, "add", "s")], "k int, seq int, op string, src string")
    chg = spark.createDataFrame([(1, 1, "update", "c"), (2, 2, "delete", "c")], "k int, seq int, op string, src string")
    got = feeds.snapshot_then_changes(snap, chg, ["k"], ["seq"])
    assert {(r["k"], r["src"]) for r in got.collect()} == {(1, "c")}


@pytest.mark.parametrize("rows_per_task", [10**6, 30])
def test_config_in_effect(spark, rows_per_task):
    events = spark.range(200).select(F.col("id").alias("t"))
    updates = spark.createDataFrame([(10, 5), (100, 7)], "t bigint, max_players int")
    got = feeds.config_in_effect(events, updates, ["t"], ["max_players"], rows_per_task=rows_per_task)
    want = {t: None if t < 10 else 5 if t < 100 else 7 for t in range(200)}
    assert {r["t"]: r["max_players"] for r in got.collect()} == want


def test_unknown_topics_have_no_handler(spark):
    df = spark.createDataFrame([("sdo/playerschanges",), ("chat/GENERAL",), ("chat/GROUP",)], "topic string")
    assert [r["handler"] for r in feeds.route_topics(df).collect()] == ["player_changes", "chat", None]


def test_membership_ignores_repeats(spark):
    log = ["exit", "enter", "enter", "exit", "exit", "enter"]
    df = spark.createDataFrame([(1, 7, i, i, k) for i, k in enumerate(log)], "entity_id int, area_id int, ts int, seq int, kind string")
    got = membership.membership_intervals(df).orderBy("entered_at").collect()
    assert [(r["entered_at"], r["left_at"]) for r in got] == [(1, 3), (5, None)]


@pytest.mark.parametrize("rows_per_task", [10**6, 3])
def test_current_parent_is_the_last_entered_and_not_left(spark, rows_per_task):
    log = [(1, "enter"), (2, "enter"), (1, "exit"), (3, "enter"), (3, "exit"), (2, "exit"), (2, "exit")]
    df = spark.createDataFrame([(9, i, i, a, k) for i, (a, k) in enumerate(log)], "entity_id int, ts int, seq int, area_id int, kind string")
    got = membership.current_parent(df, rows_per_task=rows_per_task).orderBy("seq").collect()
    assert [r["parent_area"] for r in got] == [1, 2, 2, 3, 2, None, None]


@pytest.mark.parametrize("rows_per_task", [10**6, 40])
def test_batch_sessions_equal_session_windows(spark, small, rows_per_task):
    moves = spark.read.parquet(f"{small}/events.parquet").select(
        F.col("user_id").alias("entity_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("op"),
    )
    a = player_sessions(moves, "6 hours", rows_per_task=rows_per_task).collect()
    b = player_sessions_stream(moves, "6 hours").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) > 50


def test_config_intervals_by_brute_force(spark):
    """Crowded and far updates, several variables, keys without updates, equal times."""
    rng = random.Random(5)
    updates = [(k, rng.choice([5, 5, 6, 900_000]) + rng.randrange(3) * (k + 1), i, rng.choice([None, i]), rng.choice([None, -i])) for i, k in enumerate(rng.choice([0, 1, 1, 1]) for _ in range(60))]
    events = [(rng.choice([0, 1, 2]), rng.choice([0, 4, 5, 6, 7, 8, 1000, 900_001, 10**7]), 30 + i % 40, i) for i in range(300)]
    udf, edf = spark.createDataFrame(updates, "k int, t long, seq long, a long, b long"), spark.createDataFrame(events, "k int, t long, seq long, n int")
    for keys in ([], ["k"]):
        got = feeds.config_in_effect(edf, udf, ["t", "seq"], ["a", "b"], keys)
        assert got.columns == ["k", "t", "seq", "n", "a", "b"]
        for r in got.collect():
            before = sorted(u for u in ((t, s, a, b) for k, t, s, a, b in updates if not keys or k == r.k) if u[:2] <= (r.t, r.seq))
            want = [next((u[i] for u in reversed(before) if u[i] is not None), None) for i in (2, 3)]
            assert [r.a, r.b] == want
        assert got.count() == 300


def test_config_updates_are_broadcast(spark):
    events = spark.range(1000).select(F.col("id").alias("t"))
    updates = spark.createDataFrame([(10, 5), (100, 7)], "t bigint, max_players int")
    found = feeds.config_in_effect(events, updates, ["t"], ["max_players"])
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_old_changes_do_not_win_and_gaps_are_told(spark):
    snapshot = spark.createDataFrame([("a", 1, 5)], "k string, server_id int, at int")
    rows = [("a", 1, 9, "update", 3), ("a", 1, 7, "update", 5), ("b", 2, 1, "add", 1), ("c", 1, 10, "add", 8), ("c", None, 11, "update", None), ("b", 2, 12, "update", 4)]
    changes = spark.createDataFrame(rows, "k string, server_id int, at int, op string, version long")
    versions = spark.createDataFrame([(1, 5)], "server_id int, version long")
    got = feeds.snapshot_then_changes(snapshot, changes, ["k"], ["at"], versions=versions)
    assert {r.k: r["at"] for r in got.collect()} == {"a": 5, "b": 12, "c": 11}
    gaps = feeds.change_gaps(changes, versions, "server_id", "version").collect()
    assert sorted(tuple(r) for r in gaps) == [(1, 5, 2), (2, 1, 2)]


def test_guarded_snapshot_without_broadcasts(spark, small):
    """Large tables: scans parted alike by server, versions joined by a shuffle."""
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for k in kept:
            spark.conf.set(k, "-1")
        left = QUERIES["snapshot_guard"](spark, small)
        want = QUERIES["snapshot_then_changes"](spark, small).join(spark.read.parquet(f"{small}/events.parquet").select(F.col("user_id").alias("entity_id")).distinct(), "entity_id", "left_semi")
        assert sorted(left.collect()) == sorted(want.collect())
    finally:
        for k, value in kept.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)
