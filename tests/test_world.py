"""Chunks, proximity, hierarchies, exports, tiles."""

import math
import re
import types

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from worldstate.functions import ids, spatial, terrain, text
from worldstate.operators import chunks, hierarchy, proximity, store, tiles
from worldstate.session import cut_lineage, fresh_dir
from worldstate.sources import tables, world_export
from worldstate.sources.lines import numbered_lines
from worldstate.functions.terrain import FACES
from worldstate.plans import planets
from worldstate.plans.scalars import r6

few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


def test_chunk_zero_is_twice_as_wide(spark):
    xs = [-8.0, -7.9, -0.5, 0.5, 7.9, 8.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    cx, _ = spatial.chunk_position(F.col("x"), F.col("x"), F.lit(0))
    assert [r[0] for r in df.select(cx).collect()] == [-1, 0, 0, 0, 0, 1]


def test_size_classes_include_their_bounds(spark):
    df = spark.createDataFrame([(v,) for v in (0.5, 0.51, 2.0, 2.1, 8.0, 8.1)], "s double")
    assert [r[0] for r in df.select(spatial.size_category(F.col("s"))).collect()] == [0, 1, 1, 2, 2, 3]


@few
@given(st.sets(st.integers(0, 40)), st.sets(st.integers(0, 40)))
def test_chunk_changes_partition_the_keys(spark, needed, loaded):
    a = spark.createDataFrame([(k,) for k in needed], "k int")
    b = spark.createDataFrame([(k,) for k in loaded], "k int")
    got = {r["k"]: r["action"] for r in chunks.chunk_changes(a, b, ["k"]).collect()}
    want = {k: "keep" if k in needed & loaded else "load" if k in needed else "unload" for k in needed | loaded}
    assert got == want


def test_focus_keeps_huge_nodes_and_the_square_around(spark):
    nodes = spark.createDataFrame(
        [("near", 0.1, 20.0, 20.0), ("far", 0.1, 40.0, 0.0), ("huge", 50.0, 9e5, 9e5)], "uid string, size double, x double, z double"
    )
    focus = spark.createDataFrame([(1, 0.0, 0.0)], "f int, x double, z double")
    got = chunks.focus_contents(focus, chunks.chunk_index(nodes))
    assert {r["uid"] for r in got.collect()} == {"near", "huge"}
    assert chunks.focus_chunks(focus, ["f"]).count() == 3 * 49 + 1


@pytest.mark.parametrize("few_points", [0, 4096])
@pytest.mark.parametrize("inclusive", [False, True])
def test_near_any_against_brute_force(spark, few_points, inclusive):
    """Crowded points, shapes at exactly the distance, shapes around the crowd."""
    rng = np.random.default_rng(5)
    crowd = rng.normal(size=(400, 3)) * 3 + 100
    points = np.vstack([crowd, rng.uniform(-60, 60, (60, 3)), [[0, 0, 0]]])
    ring = rng.normal(size=(200, 3))
    ring = ring / np.linalg.norm(ring, axis=1, keepdims=True) * rng.uniform(15, 35, (200, 1)) + 100
    shapes = np.vstack([ring, rng.uniform(-90, 90, (150, 3)), [[20.0, 0, 0], [0, -20.0, 0], [12.0, 16.0, 0]]])
    sdf = spark.createDataFrame(pd.DataFrame(shapes, columns=list("xyz")).assign(uid=range(len(shapes))))
    pdf = spark.createDataFrame(pd.DataFrame(points, columns=list("xyz")))
    got = {r["uid"] for r in proximity.near_any(sdf, pdf, 20.0, ["uid"], inclusive, few_points).collect()}
    gaps = ((shapes[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
    hit = gaps <= 400.0 if inclusive else gaps < 400.0
    assert got == set(np.flatnonzero(hit.any(axis=1)).tolist())


def test_near_any_settles_each_place_once(spark, monkeypatch):
    """600 shapes at 6 places: no step holds more rows than there are places; a place without a coordinate is near nothing."""
    spots = [(0.0, 0.0, 0.0), (19.0, 0.0, 0.0), (-0.0, 33.0, 0.0), (90.0, 90.0, 90.0), (40.0, -1.0, 0.0), (None, 0.0, 0.0)]
    shapes = spark.createDataFrame([(*spots[i % 6], i) for i in range(600)], "x double, y double, z double, uid int")
    points = spark.createDataFrame([(1.0, 1.0, 1.0), (-3.0, 15.0, 0.0), (59.0, 0.0, 0.0)], "x double, y double, z double")
    held = []

    def counted(df, label="step"):
        out = cut_lineage(df, label)
        held.append(out.count())
        return out

    monkeypatch.setattr(proximity, "cut_lineage", counted)
    got = proximity.near_any(shapes, points, 20.0, ["uid"], few_points=0)
    assert got.columns == ["x", "y", "z", "uid"]
    assert {r["uid"] for r in got.collect()} == {i for i in range(600) if i % 6 in (0, 1, 2, 4)}
    assert max(held) <= 6


def test_retention_asks_the_far_distance_only_where_no_point_is_near(spark, monkeypatch):
    spots = [(0.0, 0.0, 0.0), (15.0, 0.0, 0.0), (70.0, 0.0, 0.0), (None, 1.0, 1.0)]
    shapes = spark.createDataFrame([(i, *spots[i % 4]) for i in range(80)], "uid int, x double, y double, z double")
    points = spark.createDataFrame([(1.0, 0.0, 0.0)] * 3, "x double, y double, z double")
    asked, search = [], proximity.near_any

    def counted(shapes, points, *rest):
        asked.append((shapes.count(), points.count()))
        return search(shapes, points, *rest)

    monkeypatch.setattr(proximity, "near_any", counted)
    got = proximity.retention_class(shapes, points, ["uid"], 5.0, 20.0)
    assert got.columns == ["uid", "x", "y", "z", "retention"]
    want = {0: "disabled", 1: "kept", 2: "removed", 3: "removed"}
    assert {r["uid"]: r["retention"] for r in got.collect()} == {i: want[i % 4] for i in range(80)}
    assert asked == [(4, 1), (3, 1)]


def test_nearest_field_wins(spark):
    fields = spark.createDataFrame(
        [(1, 0.0, 0.0, 0.0, 10.0, 1.0), (2, 8.0, 0.0, 0.0, 10.0, 1.0)], "id int, cx double, cy double, cz double, radius double, atmosphere double"
    )
    points = spark.createDataFrame([("a", 1.0, 0.0, 0.0), ("b", 7.0, 0.0, 0.0), ("c", 50.0, 0.0, 0.0)], "k string, x double, y double, z double")
    got = {r["k"]: (r["field_id"], r["weightless"], r["up_x"]) for r in proximity.containing_field(points, fields, ["k"]).collect()}
    assert got == {"a": (1, False, 1.0), "b": (2, False, -1.0), "c": (None, True, None)}


TREE = [("a", ""), ("b", "a"), ("c", "b"), ("lost", "gone"), ("below", "lost"), ("x", "y"), ("y", "x"), ("onx", "x"), ("self", "self")]


def test_paths_leave_out_orphans_and_cycles(spark):
    chain = [(f"d{i}", f"d{i - 1}" if i else "") for i in range(70)]
    df = spark.createDataFrame(TREE + chain, "uid string, parent_uid string")
    got = {r["uid"]: (r["path"], r["depth"]) for r in hierarchy.hierarchy_paths(df).collect()}
    assert set(got) == {"a", "b", "c"} | {u for u, _ in chain}
    assert got["c"] == (["a", "b", "c"], 2)
    assert got["d69"] == ([f"d{i}" for i in range(70)], 69)


def test_subtree_orphans_children(spark):
    df = spark.createDataFrame(TREE, "uid string, parent_uid string")
    assert {(r["uid"], r["below"]) for r in hierarchy.subtree(df, "a").collect()} == {("b", 1), ("c", 2)}
    assert {r["uid"] for r in hierarchy.subtree(df, "x").collect()} == {"y", "onx", "x"}
    assert {r["uid"] for r in hierarchy.orphans(df).collect()} == {"lost"}
    wanted = spark.createDataFrame([("a",), ("x",)], "uid string")
    assert {r["uid"] for r in hierarchy.children_of(df, wanted).collect()} == {"b", "y", "onx"}


def test_bounds_merge_upwards_and_ignore_empty_boxes(spark):
    df = spark.createDataFrame(
        [("r", "", 2.0, 0.0, 0.0, 0.0), ("k", "r", 1.0, 5.0, 0.0, 0.0), ("e", "r", 0.0, 99.0, 99.0, 99.0)],
        "uid string, parent_uid string, size double, x double, y double, z double",
    )
    got = {r["uid"]: (r["lo_x"], r["hi_x"], r["bounds_size"]) for r in hierarchy.node_bounds(df).collect()}
    assert got == {"r": (-1.0, 5.5, 6.5), "k": (4.5, 5.5, 1.0), "e": (None, None, 0.0)}


def test_merged_upwards_equals_the_walk_over_ancestors(spark):
    """A chain of 300, a star of 2000, random trees, a cycle with a tail, and a missing parent."""
    rng = np.random.default_rng(8)
    parent = {"c0": ""} | {f"c{i}": f"c{i - 1}" for i in range(1, 300)} | {"s": "c7"} | {f"s{i}": "s" for i in range(2000)}
    parent |= {f"t{i}": f"t{rng.integers(0, i)}" if i > 2 else None for i in range(300)}
    lost = {"o1": "o2", "o2": "o1", "o3": "o2", "m1": "gone", "m2": "m1"}
    value = {u: None if rng.random() < 0.1 else float(rng.integers(-1000, 1000)) for u in parent | lost}
    df = spark.createDataFrame([(u, p, value[u], value[u], 1) for u, p in (parent | lost).items()], "uid string, parent_uid string, lo double, hi double, n long")
    want = {u: [] for u in parent}
    for u in parent:
        at = u
        while at:
            want[at].append(value[u])
            at = parent[at]
    got = hierarchy.merged_upwards(df, {"lo": F.min, "hi": F.max, "n": F.sum}).collect()
    assert len(got) == len(parent)
    for r in got:
        known = [x for x in want[r.uid] if x is not None]
        assert (r.lo, r.hi, r.n) == (min(known, default=None), max(known, default=None), len(want[r.uid]))


def test_a_table_of_cycles_or_no_rows_has_no_bounds(spark):
    df = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "uid string, parent_uid string, n long")
    assert hierarchy.merged_upwards(df, {"n": F.sum}).count() == hierarchy.merged_upwards(df.limit(0), {"n": F.sum}).count() == 0


def test_upsert_keeps_old_fields_and_assigns_ids(spark):
    now = spark.createDataFrame([("u1", "one", 1.0)], "uid string, name string, x double")
    new = spark.createDataFrame([("u1", None, 5.0, "k1"), (None, "two", None, "k2")], "uid string, name string, x double, uuid string")
    got = {tuple(r) for r in store.upsert_entities(now, new, identity="uuid").collect()}
    fresh = one(spark, ids.stable_uid(F.lit("k2")))
    assert got == {("u1", "one", 5.0), (fresh, "two", None)}


def test_names_with_dashes_get_a_fresh_tail(spark):
    df = spark.createDataFrame([("a-1", 0), ("a-1", 1), ("b", 0), ("b", 1)], "uid string, seq int")
    got = [r["uid"] for r in chunks.dedupe_uids(df, ["seq"]).collect()]
    assert len(set(got)) == 4 and {"a-1", "b"} < set(got)
    assert all(u.split("-")[0] in ("a", "b") for u in got)


def test_find_nodes_prefers_the_exact_uid(spark):
    df = spark.createDataFrame([("box-1",), ("1",), ("big-1",)], "uid string")
    assert [r["uid"] for r in chunks.find_nodes(df, "1").collect()] == ["1"]
    assert {r["uid"] for r in chunks.find_nodes(df, "-1").collect()} == {"box-1", "big-1"}


EXPORT = """root|"res://a.tscn"|1.5,-2,3e2|0,0,0|1,1,1|4.5|{"k":1}
\tkid-1|"res://b.tscn"|0,0,0|0,0,0|1,1,1|0.5|{}
\t\t\tdeep|"c"|0,0,0|0,0,0|1,1,1|1
\t\tshort|line|only
\t\tmid|"d"|0,0,0|0,0,0|1,1,1|1|not json

\tkid-2|"e"|0,0,0|0,0,0|1,1,1|9|{}
two|"f"|0,0,0|0,0,0|1,1,1|1|{}
"""


@pytest.mark.parametrize("rows_per_task", [10**6, 2])
def test_export_parents_are_the_nearest_shallower_line(spark, tmp_path, rows_per_task):
    (tmp_path / "w.txt").write_text(EXPORT)
    rows = world_export.read_world_export(spark, str(tmp_path), rows_per_task=rows_per_task).collect()
    assert {r["uid"]: r["parent_uid"] for r in rows} == {
        "root": "", "kid-1": "root", "deep": "kid-1", "mid": "kid-1", "kid-2": "root", "two": "",
    }
    root = next(r for r in rows if r["uid"] == "root")
    assert (root["scene"], root["x"], root["y"], root["z"], root["size"], root["properties"]) == (
        "res://a.tscn", 1.5, -2.0, 300.0, 4.5, '{"k":1}',
    )


@pytest.mark.parametrize("block", [1024, 7])
def test_export_parents_of_any_depth_equal_the_stack(spark, tmp_path, block):
    rng, want = np.random.default_rng(5), {}
    for name in ("a", "b"):
        depth, held, text = 0, [], []
        for i in range(1500):
            depth = int(rng.integers(0, depth + 3)) if rng.random() < 0.01 else min(200, depth + int(rng.integers(-1, 4)) if depth else 1)
            uid = f"{name}{i}"
            if rng.random() < 0.1:
                text.append("\t" * depth + "short|line")
                continue
            while held and held[-1][0] >= depth:
                held.pop()
            want[uid] = (depth, held[-1][1] if held else "")
            held.append((depth, uid))
            text.append("\t" * depth + f'{uid}|"s"|0,0,0|0,0,0|1,1,1|1|{{}}')
        (tmp_path / f"{name}.txt").write_text("\n".join(text))
    rows = world_export.read_world_export(spark, str(tmp_path), rows_per_task=block).collect()
    assert {r["uid"]: (r["depth"], r["parent_uid"]) for r in rows} == want and len(rows) == len(want)
    assert max(d for d, _ in want.values()) > 150


def test_lines_are_numbered_across_splits(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows = numbered_lines(spark, str(tmp_path)).collect()
        joined = numbered_lines(spark, str(tmp_path), one_text=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 6000 and all(r["value"][1:] == str(r["line_no"]) for r in rows)
    want = [f"a{i}" for i in range(3000)] + [f"b{i}" for i in range(3000)]
    assert [r["value"] for r in sorted(joined, key=lambda r: r["line_no"])] == want


def test_export_round_trip(spark):
    rng = np.random.default_rng(2)
    rows = [(f"n{i}", f"n{rng.integers(0, i)}" if i > 2 else "", "s.tscn", *map(float, rng.normal(size=10) * 10.0 ** rng.integers(-6, 9))) for i in range(120)]
    names = "uid parent_uid scene x y z rx ry rz sx sy sz size".split()
    df = spark.createDataFrame(pd.DataFrame(rows, columns=names))
    path = fresh_dir(spark, "round-trip")
    world_export.write_world_export(df, path)
    back = world_export.read_world_export(spark, path, one_text=True)
    want = {r[0]: r[1:] for r in rows}
    for r in back.collect():
        assert r["parent_uid"] == want[r["uid"]][0]
        assert np.allclose([r[n] for n in names[3:]], want[r["uid"]][2:], atol=1e-11)
    assert back.count() == 120


def test_number_text(spark):
    values = [0.0, 1.5, -2.25, 1e7, -1e7, 123456789.125, 1e-4]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(text.number_text(F.col("v"))).collect()]
    assert got == ["0.0", "1.5", "-2.25", "10000000.0", "-10000000.0", "123456789.125", "0.0001"]


def test_number_text_reads_back(spark):
    values = [0.0001234567890123456, 1e-13, 123456789012.34567, 2.0**60 + 512, 1e300, 5e-324, 0.1 + 0.2, -1e-19]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [float(r[0]) for r in df.select(text.number_text(F.col("v"))).collect()] == values


def test_zone_label_shows_unlimited_bounds(spark):
    df = spark.sql("select -1e7D as x_start, 1e3D as x_end, -1e7D as y_start, 1e7D as y_end, 0D as z_start, 5D as z_end")
    assert text.zone_label(df).first()["label"] == "Server zone | x ∞ -> 1000.0 | y ∞ -> ∞ | z 0.0 -> 5.0 |"


@pytest.mark.parametrize(
    "raw, clean", [("  a   b", " a b"), ("Zoé_1!", "Zoé_1"), ("日本", ""), ("x#  #y", "x y"), ("a-b", "a-b")]
)
def test_clean_name(spark, raw, clean):
    assert one(spark, text.clean_player_name(F.lit(raw))) == clean


def test_accept_name(spark):
    names = ["abc", "abcd", "    ", "x" * 40]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(text.accept_player_name(F.col("n"), "kept")).collect()]
    assert got == ["kept", "abcd", "kept", "x" * 32]


def test_uuid_fields_and_random_ids(spark):
    u = F.lit("00112233-4455-6677-8899-aabbccddeeff")
    big = {k: one(spark, c) for k, c in ids.uuid_fields(u).items()}
    little = {k: one(spark, c) for k, c in ids.uuid_fields(u, False).items()}
    assert big == {"low": 0x00112233, "mid": 0x4455, "hi": 0x6677, "clock": 0x8899, "node": 0xAABBCCDDEEFF}
    assert little == {"low": 0x33221100, "mid": 0x5544, "hi": 0x7766, "clock": 0x9988, "node": 0xFFEEDDCCBBAA}
    made = [r["uuid"] for r in ids.with_uuid(spark.range(50)).collect()]
    assert len(set(made)) == 50 and all(m[14] == "4" and m[19] in "89ab" for m in made)


def test_point_on_sphere_lies_one_above_and_is_fixed(spark):
    df = spark.range(200)
    zero = (F.lit(0.0),) * 3
    a = terrain.point_on_sphere(df, ["id"], zero, F.lit(10.0)).collect()
    assert a == terrain.point_on_sphere(df, ["id"], zero, F.lit(10.0)).collect()
    assert all(math.isclose(math.dist((r["px"], r["py"], r["pz"]), (0, 0, 0)), 11.0) for r in a)
    assert abs(np.mean([r["pz"] for r in a])) < 1.5


def test_quadtree_tiles_cover_each_face_once(spark):
    focus = spark.createDataFrame([(0.0, 0.0, -10.0), (10.0, 0.0, 0.0)], "x double, y double, z double")
    found = tiles.quadtree_tiles(spark, focus, 10.0, max_depth=4).toPandas()
    leaves = found[found["is_leaf"]]
    assert np.allclose(leaves.groupby("face")["size"].apply(lambda s: (s**2).sum()), 4.0)
    assert leaves["depth"].max() == 5 and leaves["path"].str.count("_").sub(1).eq(leaves["depth"]).all()
    assert set(found.loc[found["is_collision"], "depth"]) == {4}
    assert not found.duplicated(["face", "path"]).any()


def test_registered_quadtree_goes_to_full_depth(spark):
    focus, radius = [(0.0, 0.0, -8000.0), (4700.0, 4600.0, 4500.0)], planets.RADIUS
    want = set()

    def grow(face, path, cu, cv, depth):
        size = 2.0 / 2**depth
        for i in range(4):
            name, u, v = f"{path}_{i}", cu + (i % 2 * 2 - 1) * size / 4, cv + (i // 2 * 2 - 1) * size / 4
            n = FACES[face]
            a = (n[1], n[2], n[0])
            p = np.array(n) + u * np.array(a) + v * np.cross(n, a)
            p = p / np.linalg.norm(p) * radius
            split = depth < 8 and any(math.dist(p, f) <= radius * size * 0.7 for f in focus)
            if not split or depth == 7:
                want.add((face, name, depth + 1, not split, depth == 7))
            if split:
                grow(face, name, u, v, depth + 1)

    for face in range(6):
        grow(face, "Chunk_0", 0.0, 0.0, 0)
    view = types.SimpleNamespace(spark=spark, latest=spark.createDataFrame(focus, "x double, y double, z double"))
    found = [(r.face, r.path, r.depth, r.is_leaf, r.is_collision) for r in planets._tiles(view).collect()]
    assert sorted(found) == sorted(want) and max(d for _, _, d, _, _ in want) == 9


def test_quadtree_without_focus_stops_at_the_first_level(spark):
    nobody = spark.createDataFrame([], "x double, y double, z double")
    assert tiles.quadtree_tiles(spark, nobody, 10.0, max_depth=4).count() == 24


def test_scatter_is_fixed_and_in_range(spark):
    cells = spark.createDataFrame([(i, -i, 2 * i) for i in range(60)], "cx bigint, cy bigint, cz bigint")
    a = tiles.scatter_assets(cells, 3, 1000.0).toPandas()
    b = tiles.scatter_assets(cells.repartition(5), 3, 1000.0).toPandas()
    keys = ["cx", "asset_no"]
    pd.testing.assert_frame_equal(a.sort_values(keys, ignore_index=True), b.sort_values(keys, ignore_index=True))
    counts = a.groupby("cx").size()
    assert counts.between(3, 10).all() and counts.nunique() > 4 and set(a["kind"]) == {0, 1, 2}
    away = a[a["cx"] != 0]
    assert np.allclose(np.sqrt((away[["x", "y", "z"]] ** 2).sum(axis=1)), 1000.0)


def test_settings_files(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"srv{i}.ini").write_text(f'[server]\nname="dev{i}"\nport=705{i}\n\n[chat]\nurl="127.0.0.1"\nnote="a=b"\n')
    config = tables.read_fleet_config(spark, str(tmp_path))
    got = {(r["section"], r["key"], r["value"]) for r in config.collect() if r["file"].endswith("srv1.ini")}
    assert got == {("server", "name", "dev1"), ("server", "port", "7051"), ("chat", "url", "127.0.0.1"), ("chat", "note", "a=b")}
    wide = tables.fleet_table(config, ["server.name", "chat.url"]).collect()
    assert {(r["server_name"], r["chat_url"]) for r in wide} == {("dev1", "127.0.0.1"), ("dev2", "127.0.0.1")}


def test_translations(spark, tmp_path):
    (tmp_path / "l.csv").write_text('keys,en,fr,es\nHI,"Hello, you",Salut,Hola\nGO,Go,,\n')
    long = tables.read_translations(spark, str(tmp_path / "l.csv"), ["en", "fr", "es"])
    shown = {(r["key"], r["locale"]): r["shown"] for r in tables.shown_text(long).collect()}
    assert shown[("HI", "en")] == "Hello, you" and shown[("GO", "fr")] == "GO" and len(shown) == 6


def test_needed_cells_share_centres_and_changes_equal_both_sets(spark):
    """Bodies of one centre differ in reach; the cells, and what changes, are those of the plain pairs."""
    import random

    rng = random.Random(3)
    points = [(i, rng.choice([-700.0, -50.0, 0.0, 310.0, 900.0]), float(rng.randrange(-200, 200)), float(rng.randrange(-900, 900))) for i in range(60)]
    early = [(i, x + 40.0 * (i % 3), y, z) for i, x, y, z in points]
    bodies = [(b, float(b % 3 * 400), 0.0, 100.0, float(100 + b * 37)) for b in range(9)] + [(3, 5000.0, 0.0, 0.0, 9.0)]

    def plain(rows):
        out = set()
        for b, cx, cy, cz, radius in bodies:
            for _, x, y, z in rows:
                d = (x - cx, y - cy, z - cz)
                if math.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) < radius + 300.0:
                    own = [int(v / 100.0) for v in d]
                    out |= {(b, own[0] + i, own[1] + j, own[2] + k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)}
        return out

    table = lambda rows: spark.createDataFrame(rows, "k int, x double, y double, z double")
    fields = spark.createDataFrame(bodies, "id int, cx double, cy double, cz double, radius double")
    got = [tuple(r) for r in chunks.needed_cells(table(points), fields, ["k"], cell_size=100.0, spawn_distance=300.0).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(points)
    changed = chunks.needed_changes(table(points), table(early), fields, cell_size=100.0, spawn_distance=300.0).collect()
    now, old = plain(points), plain(early)
    want = {(*c, "keep" if c in now and c in old else "load" if c in now else "unload") for c in now | old}
    assert len(changed) == len(want) and {tuple(r) for r in changed} == want


def test_pairs_of_few_points_are_dealt_to_all_cores(spark):
    """Points of few bytes may have very many pairs; they must not end in one task."""
    points = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") % 100 * 90.0).alias("x"), F.lit(0.0).alias("y"), (F.col("id") * 2.0).alias("z")).distinct()
    fields = spark.range(500).select("id", (F.col("id") * 18.0).alias("cx"), F.lit(0.0).alias("cy"), (F.col("id") * 16.0).alias("cz"), F.lit(500.0).alias("radius"))
    near = proximity.entities_near(points, fields, ["k"], 100.0)
    assert "REPARTITION_BY_NUM" in near._jdf.queryExecution().executedPlan().toString()


def test_assets_are_drawn_once_per_cell_of_all_bodies(spark):
    cells = spark.range(300).select((F.col("id") % 60).alias("body_id"), *[F.lit(v).cast("bigint").alias(c) for c, v in (("cx", 1), ("cz", 2))], F.floor(F.col("id") / 60).alias("cy"))
    rows = tiles.scatter_assets(cells, kinds=4, radius=10.0)
    per_body = rows.groupBy("body_id", "cx", "cy", "cz").agg(F.sort_array(F.collect_list(F.struct("asset_no", "kind", "x", "y", "z"))).alias("a"))
    assert per_body.count() == 300 and per_body.select("cx", "cy", "cz", "a").distinct().count() == 5
    assert "BroadcastHashJoin" in rows._jdf.queryExecution().executedPlan().toString()


def test_fields_of_one_centre_and_points_of_one_place(spark):
    """Of one centre the smallest id that reaches wins; repeated places are searched once."""
    fields = [(1, 100.0), (2, 300.0), (3, 200.0), (4, 900.0), (5, 900.0)]
    fields = spark.createDataFrame([(i, 0.0, 0.0, 0.0, r, 10.0) for i, r in fields], "id int, cx double, cy double, cz double, radius double, atmosphere double")
    spots = [50.0, 250.0, 205.0, 700.0, 910.0]
    points = spark.createDataFrame([(n, spots[n % 5], 0.0, 0.0) for n in range(2000)] + [(2000, None, 0.0, 0.0)], "seq int, x double, y double, z double")
    out = proximity.containing_field(points, fields, ["seq"])
    got = {r["seq"]: r["field_id"] for r in out.collect()}
    assert got == {n: [1, 2, 2, 4, None][n % 5] for n in range(2000)} | {2000: None}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [x#" in plan, "places are made distinct before the search"


def test_scatter_writes_cells_per_centre_and_rounds_once_per_cell(spark, monkeypatch):
    """Forty bodies share two centres: their cells are never written, and no asset is rounded for every body."""
    points = [(i, float(i * 37 % 1800), float(i * 11 % 300), float(i * 53 % 1800)) for i in range(50)]
    bodies = [(b, float(b % 2 * 900), 0.0, 0.0, 300.0 + b % 5 * 100) for b in range(40)]
    view = types.SimpleNamespace(
        latest=spark.createDataFrame(points, "entity_id int, x double, y double, z double"),
        fields=spark.createDataFrame(bodies, "id int, cx double, cy double, cz double, radius double"),
    )
    cells = chunks.needed_cells(view.latest, view.fields, ["entity_id"])
    want = tiles.scatter_assets(cells, kinds=4, radius=2000.0, noise=planets._noise)
    want = {tuple(r) for r in want.select(*want.columns[:6], *[r6(F.col(a)).alias(a) for a in "xyz"]).collect()}
    n_cells = cells.count()
    written = []

    def counted(df, label="step"):
        out = cut_lineage(df, label)
        written.append(out.count())
        return out

    for module in (chunks, tiles, planets):
        monkeypatch.setattr(module, "cut_lineage", counted)
    out = planets.scatter_assets(view)
    assert written and max(written) <= n_cells / 10
    above, inline, _ = out._jdf.queryExecution().optimizedPlan().toString().partition("Generate inline")
    assert inline and "round(" not in above
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want and len({r[:4] for r in got}) == n_cells
    checked = planets.scatter_per_cell(view)
    assert max(written) <= n_cells / 10 and {tuple(r)[:4] for r in checked.collect()} == {r[:4] for r in got} and checked.count() == n_cells


def test_cells_are_widened_in_tasks_of_few_centres(spark):
    """Small rows become very many cells, so the tasks are counted by centres, not by bytes."""
    tasks = spark.sparkContext.defaultParallelism * 2
    fields = spark.range(chunks.CENTRES_PER_TASK * tasks).select("id", F.col("id").cast("double").alias("cx"), *[F.lit(v).alias(c) for c, v in (("cy", 0.0), ("cz", 0.0), ("radius", 5.0))])
    points = spark.createDataFrame([(0, 1.0, 2.0, 3.0)], "k int, x double, y double, z double")
    plan = chunks.needed_cells(points, fields, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"hashpartitioning\(_centre#\d+L?, {tasks}\), REPARTITION_BY_NUM", plan)
