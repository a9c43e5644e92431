"""Zone goldens: membership fixtures and the story of two servers."""

import json
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from worldstate.operators import feeds, zones
from worldstate.operators.spawn import resolve_spawn_point

WIDE = 10000000.0
PLAYER = "client_uuid string, name string, x double, y double, z double"
STORY = {"p1": (2145.0, 0.0, 15.67), "p2": (2151.57366, 0.0, 21.6784), "p3": (0.0, 2.5, 0.0)}


def zone_rows(spark, *rows):
    schema = "seq int, id int, name string, x_start double, x_end double, y_start double, y_end double, z_start double, z_end double"
    return spark.createDataFrame(list(rows), schema)


@pytest.fixture
def two_zones(spark):
    return zone_rows(
        spark,
        (0, 5, "gameserver0101", -WIDE, WIDE, -WIDE, WIDE, -21.0, 55.0),
        (1, 6, "gameserver0102", -WIDE, WIDE, -WIDE, WIDE, 55.0, 150.0),
    )


def test_membership_fixture(spark, two_zones):
    """Coordinates arrive as text; the third player is in no zone at all."""
    x, y = "-25.934005737305", "-0.014608105644584"
    players = spark.createDataFrame(
        [("a", 5, x, y, "3.0809617042541"), ("b", 5, x, y, "56.0809617042541"), ("c", 5, x, y, "-56.0809617042541")],
        "key string, server_id int, x string, y string, z string",
    ).withColumns({c: F.col(c).cast("double") for c in "xyz"})
    axis = {r["key"]: r["failed_axis"] for r in zones.in_own_zone(players, two_zones).collect()}
    assert axis == {"a": None, "b": "Z", "c": "Z"}
    plan = zones.plan_transfers(players, two_zones, ["key"])
    assert {(r["key"], r["target_name"], r["status"]) for r in plan.collect()} == {
        ("b", "gameserver0102", "transfer"),
        ("c", None, "no_server"),
    }


def test_upper_bound_is_inside_for_the_owner_and_outside_for_lookup(spark, two_zones):
    edge = spark.createDataFrame([("e", 5, 0.0, 0.0, 55.0)], "key string, server_id int, x double, y double, z double")
    assert zones.out_of_zone(edge, two_zones, ["key"]).isEmpty()
    assert zones.zone_assign(edge, two_zones, ["key"], own=None).first()["target_id"] == 6


def test_server_without_zone_has_the_default_one(spark, two_zones):
    far = spark.createDataFrame(
        [("in", 9, 99999.0, 0.0, 0.0), ("out", 9, 100001.0, 0.0, 0.0)], "key string, server_id int, x double, y double, z double"
    )
    assert [r["key"] for r in zones.out_of_zone(far, two_zones, ["key"]).collect()] == ["out"]


def test_two_server_story(spark):
    own = spark.createDataFrame([(k, 1, *p) for k, p in STORY.items()], "client_uuid string, server_id int, x double, y double, z double")
    one = zone_rows(spark, (0, 1, "s1", -WIDE, WIDE, -WIDE, WIDE, -WIDE, WIDE))
    report = zones.overload_report(own, one, ["client_uuid"])
    assert {r["players"] for r in report.collect()} == {3}
    message = zones.overload_messages(report, ["client_uuid"]).collect()
    assert len(message) == 1
    assert sorted((p["x"], p["y"], p["z"]) for p in json.loads(message[0]["payload"])["players"]) == sorted(STORY.values())

    halves = zones.split_plan(report, one).orderBy("half").collect()
    assert [h["axis"] for h in halves] == ["x", "x"]
    assert halves[0]["x_end"] == halves[1]["x_start"] == 2145.0
    low = [p for p in STORY.values() if p[0] < halves[0]["x_end"]]
    assert len(low) == 1, "the cut separates the third player from the other two"

    split = zone_rows(
        spark, (0, 1, "s1", -WIDE, 1000.0, -WIDE, WIDE, -WIDE, WIDE), (1, 2, "s2", 1000.0, WIDE, -WIDE, WIDE, -WIDE, WIDE)
    )
    plan = zones.plan_transfers(own, split, ["client_uuid"]).collect()
    assert {(r["client_uuid"], r["target_id"]) for r in plan} == {("p1", 2), ("p2", 2)}

    def message_of(server, op, *names):
        lists = {"add": [], "update": [], "delete": []}
        lists[op] = [dict(zip(("client_uuid", "x", "y", "z"), (n, *STORY[n]))) for n in names]
        return json.dumps(lists | {"server_id": float(server)})

    log = [message_of(1, "add", *STORY), message_of(2, "update", "p1"), message_of(2, "update", "p2")]
    feed = spark.createDataFrame(list(enumerate(log)), "seq int, payload string")
    rows = feeds.parse_change_feed(feed, PLAYER)
    state = feeds.latest_state(rows, ["client_uuid"], ["seq", "pos"])
    owner = {r["client_uuid"]: r["server_id"] for r in state.collect()}
    assert owner == {"p1": 2, "p2": 2, "p3": 1}
    population = zones.universe_population(state, split).orderBy("server_id").collect()
    assert [(r["local_players"], r["remote_players"], r["servers"]) for r in population] == [(1, 2, 2), (2, 1, 2)]


def test_overloaded_server_with_players_due_does_not_report(spark):
    split = zone_rows(spark, (0, 1, "s1", -10.0, 10.0, -1.0, 1.0, -1.0, 1.0), (1, 2, "s2", 10.0, 20.0, -1.0, 1.0, -1.0, 1.0))
    rows = [("a", 1, 0.0, 0.0, 0.0), ("b", 1, 1.0, 0.0, 0.0), ("c", 1, 2.0, 0.0, 0.0), ("d", 1, 15.0, 0.0, 0.0)]
    players = spark.createDataFrame(rows, "k string, server_id int, x double, y double, z double")
    assert zones.overload_report(players, split, ["k"]).isEmpty()
    calm = players.filter("k <> 'd'")
    assert {r["k"] for r in zones.overload_report(calm, split, ["k"]).collect()} == {"b", "c"}, "the origin is left out"
    changing = spark.createDataFrame([(1,)], "id int")
    assert zones.overload_report(calm, split, ["k"], changing).isEmpty()


def test_overlapping_zones_by_brute_force(spark):
    rng = np.random.default_rng(1)
    n = 200
    zs = pd.DataFrame({"seq": rng.permutation(n), "id": range(n), "name": [f"z{i}" for i in range(n)]})
    for a in "xyz":
        start = rng.uniform(-50, 50, n)
        size = rng.uniform(0, 40, n)
        size[rng.random(n) < 0.2] = 4e10
        zs[f"{a}_start"], zs[f"{a}_end"] = np.where(size > 1e9, -2e10, start), np.where(size > 1e9, 2e10, start + size)
    pts = pd.DataFrame({"k": range(400), "server_id": rng.integers(0, n, 400), **{a: rng.uniform(-60, 60, 400) for a in "xyz"}})
    zdf, pdf = spark.createDataFrame(zs), spark.createDataFrame(pts)
    want = {}
    for p in pts.itertuples():
        fits = zs[(zs.id != p.server_id) & np.logical_and.reduce([(zs[f"{a}_start"] <= getattr(p, a)) & (getattr(p, a) < zs[f"{a}_end"]) for a in "xyz"])]
        want[p.k] = None if fits.empty else int(fits.sort_values("seq").id.iloc[0])
    got = {r["k"]: r["target_id"] for r in zones.zone_assign(pdf, zdf, ["k"]).collect()}
    assert got == want and len(set(got.values())) > 10


@pytest.mark.parametrize("more", [0, 3000])
def test_null_infinite_and_text_zones(spark, more):
    """Few and many zones give the same rows; the additional ones lie elsewhere."""
    inf, schema = float("inf"), "seq int, id string, name string, x_start double, x_end double, y_start double, y_end double, z_start double, z_end double"
    rows = [(0, "a", "null bound", None, 9.0, -9.0, 9.0, -9.0, 9.0), (1, "b", "open", -inf, inf, -9.0, 9.0, -inf, 9.0), (2, "c", "box", 0.0, 5.0, 0.0, 50.0, 0.0, 5.0)]
    rows += [(3 + i, f"m{i}", "far", 1e5 + i, 1e5 + i + 1, 0.0, 1.0, 0.0, 1.0) for i in range(more)]
    points = [("p", "b", 1.0, 2.0, 3.0), ("q", "c", 1.0, 2.0, 3.0), ("r", None, 1.0, 40.0, 3.0), ("s", "b", -4.0, 0.0, 0.0), ("t", "c", None, 0.0, 0.0)]
    df = spark.createDataFrame(points, "k string, server_id string, x double, y double, z double")
    got = {r["k"]: r["target_id"] for r in zones.zone_assign(df, spark.createDataFrame(rows, schema), ["k"]).collect()}
    assert got == {"p": "c", "q": "b", "r": "c", "s": None, "t": None}


def test_every_point_on_a_shared_face_has_one_zone(spark):
    edges = [-10.0, -3.0, 0.0, 3.0, 10.0]
    rows, i = [], 0
    for a, b in zip(edges, edges[1:]):
        for c, d in zip(edges, edges[1:]):
            rows.append((i, i, f"z{i}", a, b, -1.0, 1.0, c, d))
            i += 1
    points = [(f"{x},{z}", x, 0.0, z) for x in edges[:-1] for z in edges[:-1]]
    df = spark.createDataFrame(points, "k string, x double, y double, z double")
    got = zones.zone_assign(df, zone_rows(spark, *rows), ["k"], own=None).collect()
    assert len(got) == 16 and len({r["target_id"] for r in got}) == 16


def test_ten_thousand_zones_over_one_cell(spark):
    """Lists stay short; what they leave out is still found."""
    from worldstate.operators.boxes import PAGE

    n = 10_000
    ids = spark.range(n).withColumn("seq", (F.col("id") * 7919 % n).cast("int"))
    sides = [F.lit(0.0).alias("x_start"), (1 + F.col("seq") / n).alias("x_end"), F.lit(0.0).alias("y_start"), F.lit(1.0).alias("y_end"), F.lit(0.0).alias("z_start"), F.lit(1.0).alias("z_end")]
    zs = ids.select("seq", "id", F.concat(F.lit("z"), F.col("id")).alias("name"), *sides)
    points = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 50).alias("server_id"), (F.col("id") / 200).alias("x"), F.lit(0.5).alias("y"), F.lit(0.5).alias("z"))
    got = {r.k: r.target_id for r in zones.zone_assign(points, zs, ["k"]).collect()}
    by_seq = sorted((i * 7919 % n, i) for i in range(n))
    want = {k: next((i for s, i in by_seq if k / 200 < 1 + s / n and i != k % 50), None) for k in range(400)}
    assert got == want and len(set(want.values())) > 150 and n > 30 * PAGE


def test_zone_lookup_does_not_shuffle_points(spark, two_zones):
    points = spark.range(100).select("id", *[F.col("id").cast("double").alias(a) for a in "xyz"])
    plan = zones.zone_assign(points, two_zones, ["id"], own=None)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "NestedLoop" not in plan
    exchanged = re.findall(r"Exchange hashpartitioning\(([^)]*)", plan)  # only zones, by their cells
    assert all(re.fullmatch(r"(_c\d#\d+L, )*_c\d#\d+L, \d+", keys) for keys in exchanged)


def test_spawn_points(spark):
    spawns = spark.createDataFrame(
        [(0, "planet", 1, 0.0, 0.0, 7.0, 9.0, 9.0, 9.0), (1, "station", 2, 5.0, 5.0, 5.0, 0.0, 0.0, 1.0)],
        "idx int, kind string, body_id int, x double, y double, z double, up_x double, up_y double, up_z double",
    )
    bodies = spark.createDataFrame([(1, 0.0, 0.0, 3.0)], "id int, cx double, cy double, cz double")
    asks = spark.createDataFrame([("p", 0), ("s", 1), ("none", 7), ("neg", -1)], "who string, spawn_point int")
    got = {r["who"]: tuple(r)[2:] for r in resolve_spawn_point(asks, spawns, bodies).collect()}
    assert got["p"] == (0.0, 0.0, 7.0, 0.0, 0.0, 1.0)
    assert got["s"] == (5.0, 5.0, 5.0, 0.0, 0.0, 1.0)
    assert got["none"] == got["neg"] == (0.0, 0.0, 0.0, 0.0, 1.0, 0.0)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 25_001])
def test_exact_medians(spark, n):
    rng = np.random.default_rng(n)
    values = {"ties": rng.integers(0, 3, n).astype(float), "spread": rng.normal(0, 1e6, n), "skew": np.where(rng.random(n) < 0.98, 7.0, rng.random(n) * 1e12)}
    df = spark.createDataFrame(pd.DataFrame([(k, float(v)) for k, own in values.items() for v in own], columns=["k", "v"])).withColumn("n", F.lit(n))
    got = {r.k: r["median"] for r in zones.exact_medians(df, ["k", "n"], "v", "n").collect()}
    assert got == {k: float(np.median(own)) for k, own in values.items()}
