"""Queries for chunks, hierarchies, the entity store and table comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from worldstate.operators import chunks, compare, hierarchy, store
from worldstate.plans.registry import query
from worldstate.plans.scalars import r6
from worldstate.session import fresh_dir
from worldstate.sources import world_export
from worldstate.sources.lines import numbered_lines

_CAT = "case when size <= 0.5 then 0 when size <= 2 then 1 when size <= 8 then 2 else 3 end"
_EDGE = "case when size <= 0.5 then 8e0 when size <= 2 then 16e0 when size <= 8 then 64e0 else 9999999999999e0 end"
_INDEX = f"""select distinct cast({_CAT} as int) as size_cat, cast(trunc(x/{_EDGE}) as bigint) as cx,
    cast(trunc(z/{_EDGE}) as bigint) as cz, uid from nodes"""


@query(_INDEX)
def chunk_index(v):
    return chunks.chunk_index(v.nodes)


@query(f"select i.size_cat, i.cx, i.cz, uid, n.name, n.size from ({_INDEX}) i join nodes n using (uid) where i.size_cat = 2")
def chunk_contents(v):
    index = chunks.chunk_index(v.nodes)
    wanted = index.filter("size_cat = 2").select("size_cat", "cx", "cz")
    return chunks.chunk_contents(index, v.nodes, wanted).select("size_cat", "cx", "cz", "uid", "name", "size")


_AROUND = """select seq, c.cat as size_cat, cast(trunc(x/10/c.edge) as bigint) + dx.d as cx, cast(trunc(z/10/c.edge) as bigint) + dz.d as cz
    from moves cross join (values (0, 8e0), (1, 16e0), (2, 64e0)) c(cat, edge)
    cross join generate_series(-3, 3) dx(d) cross join generate_series(-3, 3) dz(d)
    union all select seq, 3, 0, 0 from moves"""


def _focus(v):
    return v.moves.select("seq", (F.col("x") / 10).alias("x"), (F.col("z") / 10).alias("z"))


@query(
    f"""select seq, cast(f.size_cat as int) as size_cat, count(*) as nodes from ({_AROUND}) f
    join ({_INDEX}) i on i.size_cat = f.size_cat and i.cx = f.cx and i.cz = f.cz group by 1, 2"""
)
def focus_load(v):
    return chunks.focus_load(_focus(v), chunks.chunk_index(v.nodes), ["seq"])


@query("select entity_id, cast(size_cat as int) as size_cat, cx, cz from (" + _AROUND.replace("seq", "entity_id").replace("moves", "latest") + ") a")
def focus_chunks(v):
    focus = v.latest.select("entity_id", (F.col("x") / 10).alias("x"), (F.col("z") / 10).alias("z"))
    return chunks.focus_chunks(focus, ["entity_id"])


@query(
    f"""select i.* from ({_INDEX}) i where exists (select 1 from (select distinct size_cat, cx, cz from ({_AROUND}) a) f
      where i.size_cat = f.size_cat and i.cx = f.cx and i.cz = f.cz)"""
)
def focus_contents(v):
    return chunks.focus_contents(_focus(v), chunks.chunk_index(v.nodes))


NEEDED_SQL = """select distinct body_id, cast(trunc(dx/300e0) as bigint) + a.d as cx, cast(trunc(dy/300e0) as bigint) + b.d as cy,
    cast(trunc(dz/300e0) as bigint) + c.d as cz
    from (select f.id as body_id, p.x - f.cx as dx, p.y - f.cy as dy, p.z - f.cz as dz, f.radius from latest p, fields f) q
    cross join generate_series(-1, 1) a(d) cross join generate_series(-1, 1) b(d) cross join generate_series(-1, 1) c(d)
    where sqrt(dx*dx + dy*dy + dz*dz) < radius + 1200"""


@query(NEEDED_SQL)
def needed_cells(v):
    return chunks.needed_cells(v.latest, v.fields, ["entity_id"])


def _early(v):
    """Players where the feed first saw them."""
    first = F.min_by(F.struct("x", "y", "z"), F.struct("ts", "seq")).alias("p")
    return v.moves.groupBy("entity_id").agg(first).select("entity_id", "p.*")


@query(
    f"""select coalesce(n.body_id, l.body_id) as body_id, coalesce(n.cx, l.cx) as cx, coalesce(n.cy, l.cy) as cy, coalesce(n.cz, l.cz) as cz,
      case when l.cx is null then 'load' when n.cx is null then 'unload' else 'keep' end as action
    from ({NEEDED_SQL}) n full join ({NEEDED_SQL.replace("latest p", "(select entity_id, arg_min(x, row(ts, seq)) as x, arg_min(y, row(ts, seq)) as y, arg_min(z, row(ts, seq)) as z from moves group by entity_id) p")}) l
      on n.body_id = l.body_id and n.cx = l.cx and n.cy = l.cy and n.cz = l.cz"""
)
def chunk_changes(v):
    return chunks.needed_changes(v.latest, _early(v), v.fields)


_MOVED_NODES = "(select uid, scene, x + 5 as x, z - 3 as z, size + case when scene = 'SMALL' then 1 else 0 end as size from nodes)"


@query(
    f"""select a.uid, a.size_cat, a.cx, a.cz, b.size_cat as new_size_cat, b.cx as new_cx, b.cz as new_cz
    from ({_INDEX}) a join ({_INDEX.replace("from nodes", "from " + _MOVED_NODES + " m")}) b using (uid)
    where a.size_cat <> b.size_cat or a.cx <> b.cx or a.cz <> b.cz"""
)
def moved_chunks(v):
    grown = F.when(F.col("scene") == "SMALL", 1).otherwise(0)
    later = v.nodes.select("uid", (F.col("x") + 5).alias("x"), (F.col("z") - 3).alias("z"), (F.col("size") + grown).alias("size"))
    return chunks.moved_chunks(chunks.chunk_index(v.nodes), later)


@query("select uid, name, uid = '7' as exact from nodes where uid like '%7'")
def find_nodes(v):
    return chunks.find_nodes(v.nodes, "7").select("uid", "name", "exact")


@query(
    """select seq, case when rn > 1 then split_part(uid, '-', 1) || '-' || substr(md5(uid || '#' || rn), 1, 16) else uid end as uid
    from (select seq, concat('e', cast(entity_id as varchar), '-', cast(server_id as varchar)) as uid,
      row_number() over (partition by entity_id, server_id order by seq) as rn from moves) q"""
)
def dedupe_uids(v):
    named = v.moves.select("seq", F.concat(F.lit("e"), "entity_id", F.lit("-"), "server_id").alias("uid"))
    return chunks.dedupe_uids(named, ["seq"]).select("seq", "uid")


_TREE = """with recursive tree as (
      select uid, parent_uid, uid as path, 0 as depth, size, x, y, z, scene from nodes where parent_uid = ''
      union all
      select n.uid, n.parent_uid, t.path || '/' || n.uid, t.depth + 1, n.size, n.x, n.y, n.z, n.scene
      from nodes n join tree t on n.parent_uid = t.uid)"""


@query(f"{_TREE} select uid, path, depth from tree")
def hierarchy_paths(v):
    return hierarchy.hierarchy_paths(v.nodes).select("uid", F.array_join("path", "/").alias("path"), "depth")


@query(f"{_TREE} select uid, depth, row_number() over (order by string_split(path, '/')) as place from tree")
def preorder(v):
    return hierarchy.preorder_places(v.nodes).select("uid", "depth", "place")


@query(f"{_TREE} select uid, depth from tree where list_contains(string_split(path, '/'), 'n2') and uid <> 'n2'")
def subtree(v):
    below = hierarchy.subtree(v.nodes, "n2")
    return below.select("uid", (F.col("below") + 1).alias("depth"))


@query("select e.uid, e.name, e.parent_uid from entities e where e.parent_uid in (select uid from entities where type_obj = 'station')")
def children_of(v):
    entities = v.entities
    stations = entities.filter("type_obj = 'station'").select("uid")
    return hierarchy.children_of(entities, stations).select("uid", "name", "parent_uid")


@query(
    """select uid, parent_uid from nodes n where scene <> 'LARGE' and parent_uid <> ''
      and not exists (select 1 from nodes p where p.scene <> 'LARGE' and p.uid = n.parent_uid)"""
)
def orphans(v):
    """Nodes left without a parent once all LARGE scenes are gone."""
    return hierarchy.orphans(v.nodes.filter("scene <> 'LARGE'")).select("uid", "parent_uid")


@query(
    f"""{_TREE}, parts as (select unnest(string_split(path, '/')) as uid, size, x, y, z from tree)
    select uid, {", ".join(f"round(min({a} - size/2), 6) as lo_{a}, round(max({a} + size/2), 6) as hi_{a}" for a in "xyz")},
      round(greatest(max(x + size/2) - min(x - size/2), max(y + size/2) - min(y - size/2), max(z + size/2) - min(z - size/2)), 6) as bounds_size
    from parts group by uid"""
)
def node_bounds(v):
    out = hierarchy.node_bounds(v.nodes)
    return out.select("uid", *[r6(F.col(c)).alias(c) for c in out.columns if c != "uid"])


def _num(c: str) -> str:
    return f"cast({c} as varchar)"


@query(
    f"""{_TREE} select row_number() over (order by string_split(path, '/')) as place,
      repeat(chr(9), depth) || uid || '|"' || scene || '"|' || {_num('x')} || ',' || {_num('y')} || ',' || {_num('z')}
        || '|0.0,0.0,0.0|1.0,1.0,1.0|' || {_num('size')} || '|{{}}' as value
    from tree"""
)
def write_world_export(v):
    """Lines of the export in file order, read back from the written text."""
    path = fresh_dir(v.spark, "export")
    world_export.write_world_export(_placed(v), path)
    lines = numbered_lines(v.spark, path, one_text=True)
    return lines.select((F.col("line_no") + 1).alias("place"), "value")


def _placed(v):
    turn = {f"r{a}": F.lit(0.0) for a in "xyz"} | {f"s{a}": F.lit(1.0) for a in "xyz"}
    return v.nodes.withColumns(turn)


@query(f"{_TREE} select uid, parent_uid, depth, scene, x, y, z, size from tree")
def read_world_export(v):
    """The written export read back as nodes."""
    path = fresh_dir(v.spark, "export")
    world_export.write_world_export(_placed(v), path)
    nodes = world_export.read_world_export(v.spark, path, one_text=True)
    return nodes.select("uid", "parent_uid", "depth", "scene", "x", "y", "z", "size")


@query("select * from entities where uid = 'c42'")
def find_by_id(v):
    return store.find_by_id(v.entities, "c42")


def _typed(v):
    return v.entities.withColumn("types", F.array(F.lit("Entity"), F.col("type_obj")))


@query("select uid, name, parent_uid from entities where name = 'ASIA' and type_obj = 'Planete'")
def find_by_name(v):
    return store.find_by_name(_typed(v), "ASIA", "Planete").select("uid", "name", "parent_uid")


@query("select uid, name from nodes where list_has_any(regexp_split_to_array(lower(name), '\\W+'), ['bolt', 'ring'])")
def name_term_search(v):
    return store.name_term_search(v.nodes, ["Bolt", "ring"]).select("uid", "name")


@query(
    """select coalesce(l.k, r.k) as k, coalesce(r.name, l.name) as name, coalesce(case when r.bal > 5000 then r.bal end, l.bal) as bal
    from diff_left l full join diff_right r on l.k = r.k"""
)
def upsert_entities(v):
    """Changes give a balance only above 5000; elsewhere the old one stays."""
    changes = v.diff_right.withColumn("bal", F.when(F.col("bal") > 5000, F.col("bal")))
    return store.upsert_entities(v.diff_left, changes, "k")


@query("select * from diff_left where k not in (select k from diff_right)")
def delete_entities(v):
    return store.delete_entities(v.diff_left, v.diff_right.select("k"), "k")


@query(
    """select case when not success then 'failed' when new_uid <> '' and is_new then 'created'
      when new_uid <> '' and new_uid <> uid then 'uid changed' else 'updated' end as outcome, count(*) as requests
    from save_log group by 1"""
)
def save_outcomes(v):
    return store.save_outcomes(v.save_log)


_DIFF = """select coalesce(l.k, r.k) as k, c.col as "column",
    case c.col when 'name' then l.name else cast(l.bal as varchar) end as left_value,
    case c.col when 'name' then r.name else cast(r.bal as varchar) end as right_value,
    case when l.k is null then 'missing left' when r.k is null then 'missing right'
      when case c.col when 'name' then l.name is not distinct from r.name else l.bal is not distinct from r.bal end then 'equal'
      else 'different' end as status
    from diff_left l full join diff_right r on l.k = r.k cross join (values ('name'), ('bal')) c(col)"""


@query(_DIFF)
def diff_tables(v):
    return compare.diff_tables(v.diff_left, v.diff_right, ["k"])


@query(
    f"""select "column", count(*) filter (status='equal') as equal, count(*) filter (status='different') as different,
      count(*) filter (status='missing left') as missing_left, count(*) filter (status='missing right') as missing_right, count(*) as total
    from ({_DIFF}) d group by 1"""
)
def diff_summary(v):
    return compare.diff_summary(compare.diff_tables(v.diff_left, v.diff_right, ["k"]))


@query(
    f"""select *, (select count(*) - 30 from ({_DIFF}) e where status <> 'equal') as more
    from (select * from ({_DIFF}) d where status <> 'equal' order by k, "column" limit 30) q"""
)
def top_differences(v):
    return compare.top_differences(compare.diff_tables(v.diff_left, v.diff_right, ["k"]), ["k"])


@query(
    """select id, cast(i - 1 as int) as index, a[i] as left_value, b[i] as right_value,
      case when i > len(a) then 'missing left' when i > len(b) then 'missing right' when a[i] = b[i] then 'equal' else 'different' end as status
    from (select id, a, b, unnest(generate_series(1, greatest(len(a), len(b)))) as i
      from (select id, string_split(raw, ' ') as a, case when id % 3 = 0 then string_split(lower(raw), ' ')[:-2]
          else string_split(lower(raw), ' ') end as b from names) s) q"""
)
def diff_arrays(v):
    lower = F.split(F.lower("raw"), " ")
    shorter = F.slice(lower, F.lit(1), F.greatest(F.size(lower) - 1, F.lit(0)))  # a word less for every third text
    words = v.names.select("id", F.split("raw", " ").alias("a"), F.when(F.col("id") % 3 == 0, shorter).otherwise(lower).alias("b"))
    return compare.diff_arrays(words, "a", "b")


RULES = (
    compare.Rule("eq", "c_nationkey", "eq", 7),
    compare.Rule("ne", "c_nationkey", "ne", 7),
    compare.Rule("gt", "c_acctbal", "gt", 5000.0),
    compare.Rule("gte", "c_nationkey", "gte", 20),
    compare.Rule("lt", "c_acctbal", "lt", 100.0),
    compare.Rule("lte", "c_nationkey", "lte", 3),
    compare.Rule("almost", "c_acctbal", "almost_eq", 5000.0, 500.0),
    compare.Rule("between", "c_acctbal", "between", 1000.0, 2000.0),
    compare.Rule("backwards", "c_acctbal", "between", 2000.0, 1000.0),
    compare.Rule("not_between", "c_acctbal", "not_between", 1000.0, 2000.0),
    compare.Rule("no_null", "c_name", "not_null"),
    compare.Rule("null", "c_name", "is_null"),
    compare.Rule("contains", "c_mktsegment", "contains", "MACH"),
    compare.Rule("contains_fold", "c_mktsegment", "contains", "mach", fold_case=True),
    compare.Rule("empty", "c_mktsegment", "contains", ""),
    compare.Rule("starts", "c_mktsegment", "starts_with", "AUTO"),
    compare.Rule("ends", "c_mktsegment", "ends_with", "ING"),
    compare.Rule("has", "words", "has", "BUILDING"),
    compare.Rule("true", "rich", "is_true"),
    compare.Rule("false", "rich", "is_false"),
)
_RULE_SQL = {
    "eq": "c_nationkey = 7", "ne": "c_nationkey <> 7", "gt": "c_acctbal > 5000", "gte": "c_nationkey >= 20",
    "lt": "c_acctbal < 100", "lte": "c_nationkey <= 3", "almost": "c_acctbal >= 4500 and c_acctbal <= 5500",
    "between": "c_acctbal >= 1000 and c_acctbal <= 2000", "backwards": "false",
    "not_between": "c_acctbal < 1000 or c_acctbal > 2000", "no_null": "c_name is not null", "null": "c_name is null",
    "contains": "contains(c_mktsegment, 'MACH')", "contains_fold": "contains(lower(c_mktsegment), 'mach')", "empty": "false",
    "starts": "starts_with(c_mktsegment, 'AUTO')", "ends": "ends_with(c_mktsegment, 'ING')", "has": "c_mktsegment = 'BUILDING'",
    "true": "c_acctbal > 0", "false": "not (c_acctbal > 0)",
}


@query(
    " union all ".join(
        f"select '{n}' as rule, count(*) filter ({c}) as passed, count(*) filter (not ({c})) as failed from customer" for n, c in _RULE_SQL.items()
    )
)
def expect(v):
    rows = v.customer.withColumns({"words": F.array("c_mktsegment"), "rich": F.col("c_acctbal") > 0})
    return compare.expect(rows, RULES)


@query(
    """select count(*) filter (ok) as passed, count(*) filter (not ok) as failed
    from (select x >= y - 5000 and x <= y + 5000 and z >= x - 5000 and z <= x + 5000 as ok from moves) q"""
)
def expect_almost_vec(v):
    return compare.expect_almost_vec(v.moves, ["x", "z"], ["y", "x"], 5000.0)


@query(
    """select script, test_id, case when should_skip then 'skipped' when not was_run then 'not run' when pending_n > 0 then 'pending'
      when fail_n > 0 then 'failed' when pass_n > 0 then 'passed' else 'no asserts' end as status from test_results"""
)
def test_status(v):
    return compare.test_status(v.test_results).select("script", "test_id", "status")


@query(
    """select (select count(distinct script) from test_results where was_run) as scripts, count(*) filter (was_run) as tests,
      count(*) filter (pass_n > 0 and fail_n = 0 and pending_n = 0) as passing_tests, count(*) filter (fail_n > 0) as failing_tests,
      cast(sum(pass_n) as bigint) as passing, cast(sum(fail_n) as bigint) as failing, cast(sum(pending_n) as bigint) as pending,
      count(*) filter (should_skip or (was_run and pass_n = 0 and fail_n = 0 and pending_n = 0)) as risky
    from test_results"""
)
def test_run_totals(v):
    return compare.test_run_totals(v.test_results)


@query(
    """select script, count(*) as tests, cast(sum(fail_n) as bigint) as failures, cast(sum(pending_n) as bigint) as skipped,
      round(sum(time_taken), 6) as time from test_results where was_run or should_skip group by script"""
)
def suite_time(v):
    return compare.suite_time(v.test_results).withColumn("time", r6(F.col("time")))
