"""Queries for zones, spawns, overload and telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from worldstate.operators import batching, proximity, spawn, telemetry, zones
from worldstate.operators.feeds import latest_state
from worldstate.plans.registry import query
from worldstate.plans.scalars import r6

KEY = ["entity_id"]
_IN = "z.x_start <= p.x and p.x < z.x_end and z.y_start <= p.y and p.y < z.y_end and z.z_start <= p.z and p.z < z.z_end"
_TARGET = f"(select arg_min(z.{{c}}, z.seq) from zones z where z.id <> p.server_id and {_IN})"
_AXIS = """case when p.x < o.x_start or p.x > o.x_end then 'X' when p.y < o.y_start or p.y > o.y_end then 'Y'
    when p.z < o.z_start or p.z > o.z_end then 'Z' end"""


def _transfers(v):
    """Players whose last change was an add are still being handed over."""
    return v.latest.filter(F.col("op") == "add").select("entity_id")


@query(
    f"""select z.id as zone_id, z.name, count(p.entity_id) as players from zones z left join latest p on {_IN}
    group by z.id, z.name"""
)
def players_per_zone(v):
    """Flagship: replay the feed, find the zone of every live player, count."""
    live = latest_state(v.moves, KEY, ["ts", "seq"])
    placed = zones.zone_assign(live, v.zones, KEY, own=None)
    counts = placed.groupBy(F.col("target_id").alias("zone_id")).agg(F.count(F.lit(1)).alias("players"))
    named = v.zones.select(F.col("id").alias("zone_id"), "name")
    return named.join(counts, "zone_id", "left").select("zone_id", "name", F.coalesce("players", F.lit(0)).alias("players"))


@query(f"select p.entity_id, {_TARGET.format(c='id')} as target_id, {_TARGET.format(c='name')} as target_name from latest p")
def zone_assign(v):
    return zones.zone_assign(v.latest, v.zones, KEY).select("entity_id", "target_id", "target_name")


@query(f"select p.seq, {_TARGET.format(c='id')} as target_id from moves p")
def zone_assign_many_zones(v):
    """The grid join taken for long zone lists, on every feed row."""
    return zones.zone_assign(v.moves, v.zones, ["seq"]).select("seq", "target_id")


_OUT_ALL = f"""select p.entity_id, p.server_id, p.x, p.y, p.z, {_AXIS} as failed_axis
    from latest p join zones o on o.id = p.server_id where {_AXIS} is not null"""
_OUT = f"{_OUT_ALL} and p.op <> 'add'"


@query(_OUT)
def out_of_zone(v):
    out = zones.out_of_zone(v.latest, v.zones, KEY, _transfers(v))
    return out.select("entity_id", "server_id", "x", "y", "z", "failed_axis")


@query(
    f"""select *, case when target_id is null then 'no_server' else 'transfer' end as status
    from (select p.*, {_TARGET.format(c='id')} as target_id from ({_OUT}) p) q"""
)
def plan_transfers(v):
    plan = zones.plan_transfers(v.latest, v.zones, KEY, _transfers(v))
    return plan.select("entity_id", "server_id", "x", "y", "z", "failed_axis", "target_id", "status")


_SPAWNED = """select r.player_id, r.spawn_point, r.server_id, coalesce(s.x, 0e0) as x, coalesce(s.y, 0e0) as y,
    coalesce(s.z, 0e0) as z, s.kind, s.idx, s.x - f.cx as dx, s.y - f.cy as dy, s.z - f.cz as dz
    from spawn_requests r left join spawns s on s.idx = r.spawn_point left join fields f on f.id = s.body_id"""


@query(
    f"""select player_id, spawn_point, x, y, z,
      case when idx is null or kind = 'station' then 0e0 else round(dx / sqrt(dx*dx + dy*dy + dz*dz), 6) + 0e0 end as up_x,
      case when idx is null then 1e0 when kind = 'station' then 0e0 else round(dy / sqrt(dx*dx + dy*dy + dz*dz), 6) + 0e0 end as up_y,
      case when idx is null then 0e0 when kind = 'station' then 1e0 else round(dz / sqrt(dx*dx + dy*dy + dz*dz), 6) + 0e0 end as up_z
    from ({_SPAWNED}) q"""
)
def resolve_spawn_point(v):
    out = spawn.resolve_spawn_point(v.spawn_requests, v.spawns, v.fields)
    return out.select("player_id", "spawn_point", "x", "y", "z", *[r6(F.col(f"up_{a}")).alias(f"up_{a}") for a in "xyz"])


@query(
    f"select * from (select p.player_id, p.server_id, {_TARGET.format(c='id')} as target_id from ({_SPAWNED}) p) q where target_id is not null"
)
def new_player_placement(v):
    spawned = spawn.resolve_spawn_point(v.spawn_requests, v.spawns, v.fields)
    return zones.new_player_placement(spawned, v.zones, ["player_id"]).select("player_id", "server_id", "target_id")


@query(
    """select entity_id, case when op = 'add' then x + 10 else z end as spawn_x, case when op = 'add' then y + 10 else x end as spawn_y,
      case when op = 'add' then z + 10 else y end as spawn_z, case when server_id < 10 then 0e0 else 5e0 end as spawn_rx
    from latest"""
)
def resolve_spawn_request(v):
    asked = F.col("op") != "add"
    wants = {f"want_{a}": F.when(asked, F.col(b)) for a, b in zip("xyz", "zxy")}
    wants |= {f"want_r{a}": F.when(F.col("server_id") >= 10, F.lit(5.0)) for a in "xyz"}
    ups = {f"up_{a}": F.lit(u) for a, u in zip("xyz", (0.0, 1.0, 0.0))}
    out = spawn.resolve_spawn_request(v.latest.withColumns(wants | ups))
    return out.select("entity_id", "spawn_x", "spawn_y", "spawn_z", "spawn_rx")


@query(
    """select p.entity_id, coalesce(nullif(p.op, 'add'), 'Pigeon with no name') as label, z.name as server_label
    from latest p left join (select * from zones where id <> 4) z on z.id = p.server_id"""
)
def remote_labels(v):
    players = v.latest.withColumn("name", F.nullif("op", F.lit("add")))
    known = v.zones.filter(F.col("id") != 4)
    return zones.remote_labels(players, known).select("entity_id", "label", "server_label")


@query("select server_id, count(*) as players from latest group by server_id")
def players_per_server(v):
    return zones.players_per_server(v.latest)


@query(
    """select z.id as server_id, count(p.entity_id) as local_players, (select count(*) from latest) - count(p.entity_id) as remote_players,
      (select count(*) from zones) as servers
    from zones z left join latest p on p.server_id = z.id group by z.id"""
)
def universe_population(v):
    return zones.universe_population(v.latest, v.zones)


_CHANGING = "select n_nationkey as id from nation where n_regionkey = 0"
_REPORT = f"""select p.server_id as id, c.n as players, p.entity_id, p.x, p.y, p.z from homed p
    join (select server_id, count(*) as n from homed group by server_id having count(*) > 2) c on c.server_id = p.server_id
    where p.server_id not in ({_CHANGING}) and not (p.x = 0 and p.y = 0 and p.z = 0)"""


def _report(v):
    changing = v.nation.filter("n_regionkey = 0").select(F.col("n_nationkey").alias("id"))
    return zones.overload_report(v.homed, v.zones, KEY, changing)


@query(_REPORT)
def overload_report(v):
    return _report(v)


@query(
    f"""select * from (select p.server_id as id, count(*) as players from settling p group by p.server_id) q
    where players > 2 and id not in (
      select server_id from (select p.server_id, {_TARGET.format(c="id")} as target_id
        from ({_OUT_ALL.replace("latest", "settling")}) p) d
      where target_id is not null)"""
)
def overload_with_transfers_due(v):
    """New players are still on the servers they signed up with; their servers transfer them instead."""
    report = zones.overload_report(v.settling, v.zones, KEY)
    return report.groupBy("id").agg(F.max("players").alias("players"))


@query(
    f"""select id, cast(floor((n-1)/3.0e0) as int) as part, count(*) as positions
    from (select *, row_number() over (partition by id order by entity_id) as n from ({_REPORT}) r) q
    group by id, cast(floor((n-1)/3.0e0) as int)"""
)
def overload_messages(v):
    return zones.overload_messages(_report(v), ["entity_id"], max_positions=3).select(
        "id", "part", F.col("positions").cast("bigint").alias("positions")
    )


_SPREAD = f"""select id, median(case axis when 'x' then x when 'y' then y else z end) as cut, axis
    from ({_REPORT}) r join (select id, case when sx >= sy and sx >= sz then 'x' when sz >= sy then 'z' else 'y' end as axis
      from (select id, max(x)-min(x) as sx, max(y)-min(y) as sy, max(z)-min(z) as sz from ({_REPORT}) r group by id) s) a using (id)
    group by id, axis"""


@query(
    f"""select id, axis, cut, cast(half as int) as half,
      case when axis='x' and half=1 then cut else x_start end as x_start, case when axis='x' and half=0 then cut else x_end end as x_end,
      case when axis='y' and half=1 then cut else y_start end as y_start, case when axis='y' and half=0 then cut else y_end end as y_end,
      case when axis='z' and half=1 then cut else z_start end as z_start, case when axis='z' and half=0 then cut else z_end end as z_end
    from ({_SPREAD}) s join zones using (id) cross join (values (0), (1)) h(half)"""
)
def split_plan(v):
    return zones.split_plan(_report(v), v.zones)


@query(
    """select id, to_split_server_id is not null as pushes_players, to_merge_server_id is null as active,
      coalesce(to_merge_server_id, to_split_server_id) as hands_over_to
    from ordered_zones where to_split_server_id is not null or to_merge_server_id is not null"""
)
def zone_split_state(v):
    return zones.zone_split_state(v.ordered_zones).select("id", "pushes_players", "active", "hands_over_to")


@query(
    """select server_id, coalesce(n, 0) as currentplayers, coalesce(a, 0) as currentbox50cm, coalesce(b, 0) as currentbox4m,
      coalesce(c, 0) as currentship
    from (select server_id, count(*) as n from latest group by server_id) p full join
      (select server_id, count(*) filter (prop_type='box50cm') as a, count(*) filter (prop_type='box4m') as b,
        count(*) filter (prop_type='ship') as c from moves where op <> 'delete' group by server_id) q using (server_id)"""
)
def server_metrics(v):
    return telemetry.server_metrics(v.latest, v.moves.filter("op <> 'delete'"))


_MEASURES = ("memory", "numberobjects", "timefps", "currentplayers")


@query(
    "select server_id, time_bucket(interval '1 minute', ts) as window_start, count(*) as samples, "
    + ", ".join(f"avg({m}) as avg_{m}, max({m}) as max_{m}" for m in _MEASURES)
    + " from samples group by 1, 2"
)
def metrics_windows(v):
    return telemetry.metrics_windows(v.samples)


@query(
    """select server_id as planet, round(min(sqrt(x*x + y*y + z*z)), 6) as min_height, round(max(sqrt(x*x + y*y + z*z)), 6) as max_height
    from moves group by server_id"""
)
def planet_height_range(v):
    out = telemetry.planet_height_range(v.moves.withColumn("planet", F.col("server_id")))
    return out.select("planet", r6(F.col("min_height")).alias("min_height"), r6(F.col("max_height")).alias("max_height"))


@query(
    """select prop_type as value, n, count(*) over () as unique_values, cast(sum(n) over () as bigint) as sum_n, max(n) over () as max_n
    from (select prop_type, count(*) as n from moves group by prop_type) q"""
)
def value_counts(v):
    return telemetry.value_counts(v.moves, "prop_type")


@query("select distinct area_id, entity_id from membership")
def group_members(v):
    return telemetry.group_members(v.membership, "area_id", "entity_id")


@query("select area_id, count(distinct entity_id) as members from membership group by area_id")
def group_sizes(v):
    return telemetry.group_sizes(v.membership, "area_id", "entity_id")


@query(
    """select coalesce(type_obj, 'all') as kind, cast(count(*) as bigint) as objects from entities group by rollup(type_obj)"""
)
def universe_inventory(v):
    return telemetry.universe_inventory(v.entities)


_NEAR = """(p.x-f.cx)*(p.x-f.cx) + (p.y-f.cy)*(p.y-f.cy) + (p.z-f.cz)*(p.z-f.cz)"""


@query(
    f"""select p.entity_id, f.id as body_id, round(sqrt({_NEAR}), 6) as distance
    from latest p join fields f on sqrt({_NEAR}) < f.radius + 1200"""
)
def entities_near(v):
    near = proximity.entities_near(v.latest, v.fields, KEY, 1200.0)
    return near.select("entity_id", "body_id", r6(F.col("distance")).alias("distance"))


@query(
    f"""select p.seq, arg_min(f.id, row(sqrt({_NEAR}), f.id)) as field_id, count(f.id) = 0 as weightless
    from moves p left join fields f on sqrt({_NEAR}) < f.radius + f.atmosphere group by p.seq"""
)
def containing_field(v):
    return proximity.containing_field(v.moves, v.fields, ["seq"]).select("seq", "field_id", "weightless")


_HIT = "(s.x-p.x)*(s.x-p.x) + (s.y-p.y)*(s.y-p.y) + (s.z-p.z)*(s.z-p.z) < {d}"


@query(f"select uid from shapes s where exists (select 1 from moves p where {_HIT.format(d='1000000')})")
def near_any(v):
    """With few_points=0: the summary route taken for large point sets."""
    return proximity.near_any(v.shapes, v.moves, 1000.0, ["uid"], few_points=0).select("uid")


@query(
    f"""select uid, case when a then 'disabled' when not b then 'removed' else 'kept' end as retention from (
      select uid, exists (select 1 from moves p where {_HIT.format(d='160000')}) as a,
        exists (select 1 from moves p where {_HIT.format(d='1000000')}) as b from shapes s) q"""
)
def retention_class(v):
    return proximity.retention_class(v.shapes, v.moves, ["uid"]).select("uid", "retention")


_MADE = """select *, failed and attempt_no = 3 as gave_up from (
    select *, row_number() over (partition by batch_no order by seq) as attempt_no,
      coalesce(max(cast(not failed as int)) over (partition by batch_no order by seq rows between unbounded preceding and 1 preceding), 0) as done
    from attempts) q where attempt_no <= 3 and done = 0"""


@query(
    f"""select batch_no, seq, cast(attempt_no as int) as attempt_no, failed,
      case when failed and attempt_no < 3 then cast(50 * pow(2, attempt_no - 1) as int) end as delay_ms, gave_up
    from ({_MADE}) m"""
)
def retry_schedule(v):
    made = batching.retry_schedule(v.attempts, ["batch_no"], ["seq"])
    return made.select("batch_no", "seq", "attempt_no", "failed", "delay_ms", "gave_up")


@query(
    f"""select server_id, count(*) filter (not failed) as successful, count(*) filter (failed) as aborted,
      count(*) filter (not failed and kind='Mutation') as mutations, count(*) filter (not failed and kind='Deletion') as deletions,
      count(*) filter (not failed) as total_items, count(*) filter (not failed) / count(*) * 100e0 as success_rate
    from ({_MADE}) m group by server_id"""
)
def batch_stats(v):
    made = batching.retry_schedule(v.attempts, ["batch_no"], ["seq"])
    return batching.batch_stats(made, ["server_id"])


@query(
    f"""with recursive tally as (
      select server_id, batch_no, row_number() over w as rn, sum(s) over w as wins, sum(a) over w as losses
      from (select server_id, batch_no, count(*) filter (not failed) as s, count(*) filter (failed) as a from ({_MADE}) m group by 1, 2) q
      window w as (partition by server_id order by batch_no)),
    run as (
      select server_id, 0 as rn, 200 as size from (select distinct server_id from tally) d
      union all
      select t.server_id, t.rn, case when wins + losses < 10 then size
          when wins / (wins + losses) * 100e0 < 80 and size > 20 then greatest(size // 2, 20)
          when wins / (wins + losses) * 100e0 > 95 and size < 1000 and wins % 20 = 0 then least(size + 50, 1000)
          else size end
      from run join tally t on t.server_id = run.server_id and t.rn = run.rn + 1)
    select t.server_id, t.batch_no, cast(wins as bigint) as wins, cast(losses as bigint) as losses, cast(size as int) as batch_size
    from run join tally t on t.server_id = run.server_id and t.rn = run.rn"""
)
def batch_size_controller(v):
    made = batching.retry_schedule(v.attempts, ["batch_no"], ["seq"])
    batches = made.groupBy("server_id", "batch_no").agg(
        F.count_if(~F.col("failed")).alias("successes"), F.count_if("failed").alias("aborts")
    )
    return batching.batch_size_controller(batches)
