"""Values that must not get lost on the way."""

from pyspark.sql import functions as F

from worldstate.functions import text
from worldstate.operators import compare, feeds, hierarchy, membership, zones
from worldstate.session import fresh_dir
from worldstate.streaming.state_table import PartialStateTable

ENTITY = "entity_id bigint, level int, x double, name string"


def test_whole_numbers_written_with_a_point(spark):
    rows = [
        (1, '{"server_id": 1.0, "add": [{"entity_id": 1.0, "level": 2, "x": 3, "name": "a"}, {"entity_id": 9007199254740993, "level": 4.0, "x": 0.5}]}'),
        (2, '{"server_id": 1, "update": [{"entity_id": 1.5, "level": 1}]}'),
        (3, "no envelope"),
        (4, '{"server_id": 1, "delete": [{"entity_id": null}]}'),
    ]
    df = spark.createDataFrame(rows, "n int, payload string")
    got = [tuple(r) for r in feeds.parse_change_feed(df, ENTITY).orderBy("n", "op", "pos").collect()]
    assert got == [
        (1, 1, "add", 0, 1, 2, 3.0, "a"), (1, 1, "add", 1, 9007199254740993, 4, 0.5, None), (2, 1, "update", 0, None, 1, None, None),
        (4, 1, "delete", 0, None, None, None, None),
    ]
    assert sorted(r.n for r in feeds.rejected_envelopes(df, entity_schema=ENTITY).collect()) == [2, 3]
    assert [r.n for r in feeds.rejected_envelopes(df).collect()] == [3]


def test_compaction_of_partial_updates_keeps_fields(spark):
    schema = "k int, seq int, op string, name string, ip string"
    batches = [
        [(1, 1, "add", "bob", "a"), (2, 2, "add", "eve", "b"), (3, 3, "add", None, None)],
        [(1, 4, "update", None, "c"), (2, 5, "delete", None, None), (1, 6, "update", None, None)],
        [(2, 7, "add", None, "d")],
    ]
    table = PartialStateTable(fresh_dir(spark, "partial"), ["k"], ["seq"], schema, ["name", "ip"])
    for n, rows in enumerate(batches):
        table.write(spark.createDataFrame(rows, schema), n)
    small = table.compact(spark, fresh_dir(spark, "compact"))
    want = [(1, "bob", "c"), (2, None, "d"), (3, None, None)]
    assert [tuple(r) for r in small.current(spark).orderBy("k").collect()] == want
    assert small.changes(spark).count() < 7
    small.write(spark.createDataFrame([(2, 4, "update", "late", None), (1, 8, "update", "rob", None)], schema), 1)
    assert [tuple(r) for r in small.current(spark).orderBy("k").collect()] == [(1, "rob", "c"), *want[1:]]


def test_area_ids_pass_unchanged(spark):
    big = 9007199254740993
    for a, b, kind in ((big, big - 1, "bigint"), ("hall", "room", "string")):
        rows = [(1, 1, a, "enter"), (1, 2, b, "enter"), (1, 3, b, "exit"), (1, 4, a, "exit")]
        df = spark.createDataFrame(rows, f"entity_id int, seq int, area_id {kind}, kind string")
        got = membership.current_parent(df, order=("seq",)).orderBy("seq").collect()
        assert [r.parent_area for r in got] == [a, b, a, None] and [r.area_id for r in got] == [a, b, b, a]


def test_line_of_an_unknown_channel(spark):
    df = spark.sql("select timestamp'2024-01-01 01:02:03' as ts, 'ann' as author, 77 as channel, 'hi' as content")
    assert text.format_chat_line(df).first()["line"] == "[01:02:03] : ann hi"


def test_overloaded_server_without_positions_reports(spark):
    zone = spark.createDataFrame([(0, 1, "s", -9.0, 9.0, -9.0, 9.0, -9.0, 9.0)], "seq int, id int, name string, x_start double, x_end double, y_start double, y_end double, z_start double, z_end double")
    players = spark.createDataFrame([(i, 1, 0.0, 0.0, 0.0) for i in range(3)], "k int, server_id int, x double, y double, z double")
    report = zones.overload_report(players, zone, ["k"])
    assert [(r.id, r.players, r.x) for r in report.collect()] == [(1, 3, None)]
    message = zones.overload_messages(report, ["k"]).first()
    assert (message.positions, message.payload) == (0, '{"id":1,"players":[]}')
    assert zones.split_plan(report, zone).isEmpty()


def test_number_against_text_by_value(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (4, 4.0)], "k int, v double")
    b = spark.createDataFrame([(1, "1"), (2, "two"), (3, None), (4, None)], "k int, v string")
    got = {r.k: r.status for r in compare.diff_tables(a, b, ["k"], deep=False).collect()}
    assert got == {1: "equal", 2: "different", 3: "equal", 4: "different"}


def test_bounds_of_empty_subtrees(spark):
    rows = [("a", "", 0.0, 1.0), ("b", "a", 2.0, 1.0), ("c", "a", 0.0, 5.0), ("d", "c", 0.0, 6.0)]
    df = spark.createDataFrame(rows, "uid string, parent_uid string, size double, x double").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    got = {r.uid: (r.lo_x, r.hi_x, r.bounds_size) for r in hierarchy.node_bounds(df).collect()}
    assert got == {"a": (0.0, 2.0, 2.0), "b": (0.0, 2.0, 2.0), "c": (None, None, 0.0), "d": (None, None, 0.0)}
