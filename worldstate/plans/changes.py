"""Queries for change feeds, windows over entities and batching."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from worldstate.operators import batching, chunks, feeds, membership, telemetry
from worldstate.operators.ordered import order_value
from worldstate.plans.registry import query
from worldstate.streaming import alerts, sessions

KEY, ORDER = ["entity_id"], ["ts", "seq"]
ENTITY = "entity_id bigint, seq bigint, x double, y double, z double"


def envelopes(v, max_entities: int = 10_000):
    """The feed as published: one envelope per server and hour."""
    moves = v.moves.withColumn("tick", F.date_trunc("hour", "ts"))
    return feeds.publish_change_feed(moves, "tick", ORDER, ["entity_id", "seq", "x", "y", "z"], max_entities=max_entities)


@query(
    """select server_id, date_trunc('hour', ts) as tick, count(*) filter (op='add') as n_add,
      count(*) filter (op='update') as n_update, count(*) filter (op='delete') as n_delete
    from moves group by 1, 2"""
)
def publish_change_feed(v):
    sizes = [F.col(f"n_{op}").cast("bigint").alias(f"n_{op}") for op in feeds.OPS]
    return envelopes(v).select("server_id", F.col("tick").cast("timestamp_ntz").alias("tick"), *sizes)


@query(
    """select server_id, op, cast(row_number() over (partition by server_id, date_trunc('hour', ts), op order by ts, seq) - 1 as int) as pos,
      entity_id, seq, x, y, z from moves"""
)
def parse_change_feed(v):
    """Rows published as JSON envelopes and parsed again."""
    parsed = feeds.parse_change_feed(envelopes(v).select("payload"), ENTITY)
    return parsed.select("server_id", "op", "pos", "entity_id", "seq", "x", "y", "z")


@query(
    """select event_id as n from events where event_id % 7 in (0, 1)"""
)
def rejected_envelopes(v):
    """Texts that are no envelope, and envelopes with a fraction where a whole number belongs."""
    whole = F.format_string('{"server_id": 1.0, "add": [{"entity_id": %d.0, "seq": 2, "x": 1}]}', F.col("event_id"))
    fraction = F.format_string('{"server_id": 1, "update": [{"entity_id": %d.5}]}', F.col("event_id"))
    kind = F.col("event_id") % 7
    rows = v.events.select(F.col("event_id").alias("n"), F.when(kind == 0, F.col("event_type")).when(kind == 1, fraction).otherwise(whole).alias("payload"))
    return feeds.rejected_envelopes(rows, entity_schema=ENTITY).select("n")


@query(
    """select event_id as n, 1 as server_id, event_id as entity_id, 9007199254740993 as seq, cast(event_id as double) as x from events"""
)
def parse_written_numbers(v):
    """Whole numbers written with a point, and one that a DOUBLE can't hold."""
    body = F.format_string('{"server_id": 1.0, "add": [{"entity_id": %d.0, "seq": 9007199254740993, "x": %d}]}', F.col("event_id"), F.col("event_id"))
    rows = v.events.select(F.col("event_id").alias("n"), body.alias("payload"))
    return feeds.parse_change_feed(rows, ENTITY).select("n", "server_id", "entity_id", "seq", "x")


_LAG = "lag({c}, 1, 0e0) over (partition by entity_id order by ts, seq)"


@query(
    f"""select entity_id, seq, x, y, z from (select *, {_LAG.format(c='x')} as px, {_LAG.format(c='y')} as py, {_LAG.format(c='z')} as pz
      from moves where entity_id not in (select entity_id from latest where op = 'add')) q
    where x <> px or y <> py or z <> pz"""
)
def moved_since_last(v):
    transfers = v.latest.filter("op = 'add'").select("entity_id")
    moved = feeds.moved_since_last(v.moves, KEY, ORDER, ["x", "y", "z"], transfers)
    return moved.select("entity_id", "seq", "x", "y", "z")


@query(
    """select entity_id, bucket, arg_max(seq, row(ts, seq)) as seq from (
      select *, epoch_us(ts) * 30 // 3601000000 as bucket from moves) q group by entity_id, bucket"""
)
def tick_sample(v):
    out = feeds.tick_sample(v.moves, KEY, ORDER, feeds.OVERLOAD_TICKS)
    return out.select("entity_id", "bucket", "seq")


@query("select entity_id, server_id, op, x, y, z from latest")
def latest_state(v):
    return feeds.latest_state(v.moves, KEY, ORDER).select("entity_id", "server_id", "op", "x", "y", "z")


def customer_snapshot(v):
    """One row per customer, older than every change."""
    start = F.lit("2000-01-01").cast("timestamp_ntz")
    return v.customer.select(
        F.col("c_custkey").alias("entity_id"), F.lit(-1).cast("bigint").alias("seq"), start.alias("ts"),
        F.col("c_nationkey").alias("server_id"), F.lit("add").alias("op"),
    )


@query(
    """select coalesce(m.entity_id, c_custkey) as entity_id, coalesce(m.server_id, c_nationkey) as server_id
    from customer full join (select entity_id, arg_max(server_id, row(ts, seq)) as server_id, arg_max(op, row(ts, seq)) as op
      from moves group by entity_id) m on c_custkey = m.entity_id
    where m.op is null or m.op <> 'delete'"""
)
def snapshot_then_changes(v):
    changes = v.moves.select("entity_id", "seq", "ts", "server_id", "op")
    return feeds.snapshot_then_changes(customer_snapshot(v), changes, KEY, ORDER).select("entity_id", "server_id")


_VERSIONED = """numbered as (select *, row_number() over (partition by server_id order by seq) as version, count(*) over (partition by server_id) as n from moves)"""


def _versioned(v):
    """Moves numbered per sender; a snapshot knows the first half (``_known``) of each sender's."""
    own = Window.partitionBy("server_id")
    moves = v.moves.select("entity_id", "seq", "server_id", "op")
    numbered = moves.withColumns({"version": F.row_number().over(own.orderBy("seq")).cast("bigint"), "_n": F.count(F.lit(1)).over(own)})
    numbered = numbered.withColumn("_known", F.expr("2 * version <= _n")).drop("_n")
    early = numbered.filter("_known").drop("_known")
    return numbered, early, early.groupBy("server_id").agg(F.max("version").alias("version"))


@query("select entity_id, arg_max(server_id, seq) as server_id from moves group by entity_id having arg_max(op, seq) <> 'delete'")
def snapshot_guard(v):
    """Changes the snapshot already holds come again, after all others, and don't win."""
    changes, early, versions = _versioned(v)
    state = feeds.latest_state(early, KEY, ["seq"])
    # one scan gives both arrivals: a union of two scans parted alike can't be zipped with the versions once one side is coalesced
    again = F.when(F.col("_known"), F.array("seq", F.col("seq") + 1_000_000_000_000)).otherwise(F.array("seq"))
    arrived = changes.withColumn("arrival", F.explode(again)).drop("_known")
    found = feeds.snapshot_then_changes(state.withColumn("arrival", F.col("seq")), arrived, KEY, ["arrival"], versions=versions)
    return found.select("entity_id", "server_id")


@query(
    f"""with {_VERSIONED}, got as (select server_id, version from numbered where 2 * version > n and version % 10 <> 0
      union select server_id, max(version) from numbered where 2 * version <= n group by server_id)
    select server_id, version as after, later - version - 1 as missing
    from (select *, lead(version) over (partition by server_id order by version) as later from got) g where later - version > 1"""
)
def change_gaps(v):
    """Every tenth change never arrives."""
    changes, _, versions = _versioned(v)
    return feeds.change_gaps(changes.drop("_known").filter("version % 10 <> 0"), versions, "server_id", "version")


def partial_changes(v):
    """Updates give the position only; adds give the kind as well."""
    return v.moves.select(
        "entity_id", "ts", "seq", "op", F.when(F.col("op") == "add", F.col("prop_type")).alias("prop_type"), "x", "z"
    )


ZONE_STATE_SQL = """select entity_id, arg_max(prop_type, row(ts, seq)) filter (op = 'add') as prop_type, arg_max(x, row(ts, seq)) as x,
      arg_max(z, row(ts, seq)) as z
    from (select m.*, coalesce(row(ts, seq) > g, true) as alive from moves m left join
      (select entity_id, max(row(ts, seq)) as g from moves where op = 'delete' group by entity_id) d using (entity_id)) q
    where alive and op <> 'delete' group by entity_id"""


@query(ZONE_STATE_SQL)
def zone_state_merge(v):
    """Batch twin of the zone state stream: fields missing from an update keep their value."""
    return feeds.merge_partial_updates(partial_changes(v), KEY, ORDER, ["prop_type", "x", "z"])


@query(
    """select seq_conv, turn, channel from (select *, row_number() over (partition by channel order by seq_conv desc, turn desc) as rn
      from chat) q where rn <= 50"""
)
def keep_last_messages(v):
    return feeds.keep_last_messages(v.chat, ["channel"], ["seq_conv", "turn"]).select("seq_conv", "turn", "channel")


@query(
    """select m.seq, (select arg_max(u.max_players, row(u.ts, u.seq)) from config_updates u where row(u.ts, u.seq) <= row(m.ts, m.seq)) as max_players
    from moves m"""
)
def config_in_effect(v):
    out = feeds.config_in_effect(v.moves, v.config_updates, ORDER, ["max_players"])
    return out.select("seq", "max_players")


_FLIPS = """select *, lead(ts) over (partition by entity_id, area_id order by ts, seq) as left_at from (
    select *, coalesce(lag(kind) over (partition by entity_id, area_id order by ts, seq), 'exit') as before from membership) q
    where kind <> before"""


@query(f"select entity_id, area_id, ts as entered_at, left_at from ({_FLIPS}) f where kind = 'enter'")
def membership_intervals(v):
    return membership.membership_intervals(v.membership).select("entity_id", "area_id", "entered_at", "left_at")


@query(
    f"""select m.seq, arg_max(i.area_id, row(i.ts, i.seq)) as parent_area
    from membership m left join (select *, lead(seq) over (partition by entity_id, area_id order by ts, seq) as left_seq
        from ({_FLIPS}) f) i
      on i.kind = 'enter' and i.entity_id = m.entity_id and row(i.ts, i.seq) <= row(m.ts, m.seq)
        and (i.left_at is null or row(m.ts, m.seq) < row(i.left_at, i.left_seq))
    group by m.seq"""
)
def current_parent(v):
    return membership.current_parent(v.membership).select("seq", "parent_area")


FLUSH_SQL = """with recursive numbered as (
      select *, row_number() over (partition by server_id order by ts, seq) as rn from ops),
    run as (
      select server_id, rn, seq, 1 as batch_no, 1 as held, ts as last_flush, priority = 0 as flush, ts from numbered where rn = 1
      union all
      select n.server_id, n.rn, n.seq, r.batch_no + cast(r.flush as int),
        case when r.flush then 1 else r.held + 1 end,
        case when r.flush then r.ts else r.last_flush end,
        case when r.flush then 1 else r.held + 1 end >= 200 or n.priority = 0
          or epoch_us(n.ts) - epoch_us(case when r.flush then r.ts else r.last_flush end) > 5000000,
        n.ts
      from run r join numbered n on n.server_id = r.server_id and n.rn = r.rn + 1)"""


@query(f"{FLUSH_SQL} select seq, server_id, cast(batch_no as bigint) as batch_no from run")
def batch_assign(v):
    return batching.batch_assign(v.ops).select("seq", "server_id", "batch_no")


@query(
    f"""{FLUSH_SQL} select r.seq, r.server_id, cast(batch_no as bigint) as batch_no,
      cast(row_number() over (partition by r.server_id, batch_no order by o.kind = 'Deletion', o.priority, r.seq) as int) as position
    from run r join ops o using (seq)"""
)
def batch_order(v):
    ordered = batching.batch_order(batching.batch_assign(v.ops))
    return ordered.select("seq", "server_id", "batch_no", "position")


CAMERA_SQL = """with recursive numbered as (
      select *, row_number() over (partition by camera_id order by ts, seq) as rn from camera),
    run as (
      select camera_id, 0 as rn, cast(null as bigint) as seq, false as updated, 0e0 as hx, 0e0 as hy, 0e0 as hz
      from (select distinct camera_id from camera) c
      union all
      select n.camera_id, n.rn, n.seq, d >= 0.8e0, case when d >= 0.8e0 then x else hx end, case when d >= 0.8e0 then y else hy end,
        case when d >= 0.8e0 then z else hz end
      from (select n.*, hx, hy, hz, sqrt((x-hx)*(x-hx) + (y-hy)*(y-hy) + (z-hz)*(z-hz)) as d
        from run r join numbered n on n.camera_id = r.camera_id and n.rn = r.rn + 1) n)
    select camera_id, seq from run where updated"""


@query(CAMERA_SQL)
def camera_updates(v):
    return chunks.camera_updates(v.camera, ["camera_id"], ORDER).select("camera_id", "seq")


@query(
    """select seq, entity_id, coalesce(value - last_value(mark ignore nulls) over (partition by entity_id order by ts, seq rows unbounded preceding), -1) as since
    from (select *, case when op = 'add' then value end as mark from moves) q"""
)
def counter_since(v):
    rows = v.moves.withColumn("is_marker", F.col("op") == "add")
    return telemetry.counter_since(rows, ORDER, "value", keys=KEY).select("seq", "entity_id", "since")


def overload_events(v):
    """Player counts per server; a delete stands for a completed zone change."""
    kind = F.when(F.col("op") == "delete", "zone_changed").otherwise("population")
    return v.moves.select("server_id", "ts", "seq", kind.alias("kind"), (F.col("seq") % 7).cast("int").alias("players"))


ALERT_SQL = """select server_id, min_by(seq, row(ts, seq)) as seq from (
      select *, sum(cast(op = 'delete' as int)) over (partition by server_id order by ts, seq) as round from moves) q
    where op <> 'delete' and seq % 7 > 2 group by server_id, round"""


@query(ALERT_SQL)
def overload_alerts(v):
    return alerts.overload_alerts(overload_events(v)).select("server_id", "seq")


def transfer_events(v):
    event = (
        F.when(F.col("op") == "add", "plan")
        .when(F.col("op") == "delete", "disconnect")
        .when(F.col("prop_type") == "ship", "remote_update")
        .otherwise("local_update")
    )
    return v.moves.select("entity_id", "ts", "seq", order_value(v.moves, "ts").alias("micros"), event.alias("event"))


TRANSFER_SQL = """select seq, coalesce(mark = 'plan', false) as in_transfer,
      case event when 'plan' then case when coalesce(before = 'plan', false) then 'none' else 'open' end
        when 'remote_update' then case when coalesce(before = 'plan', false) then 'close' else 'none' end
        when 'disconnect' then case when coalesce(before = 'plan', false) then 'none' else 'delete' end else 'none' end as action
    from (select *, last_value(edge ignore nulls) over (w rows unbounded preceding) as mark,
        last_value(edge ignore nulls) over (w rows between unbounded preceding and 1 preceding) as before
      from (select *, case when event in ('plan', 'remote_update') then event end as edge from (
        select *, case when op = 'add' then 'plan' when op = 'delete' then 'disconnect' when prop_type = 'ship' then 'remote_update'
          else 'local_update' end as event from moves) a) b
      window w as (partition by entity_id order by ts, seq)) q"""


@query(TRANSFER_SQL)
def transfer_tracker(v):
    return alerts.transfer_tracker(transfer_events(v)).select("seq", "in_transfer", "action")


SESSION_SQL = """select entity_id, min(ts) as started_at, max(until) as ended_at, count(*) as events from (
      select *, sum(cast(reach is null or ts > reach as int)) over (partition by entity_id order by ts, seq) as s from (
        select *, max(until) over (partition by entity_id order by ts, seq rows between unbounded preceding and 1 preceding) as reach from (
          select *, ts + case when op = 'delete' then interval '1 second' else interval '6 hours' end as until from moves) a) b) c
    group by entity_id, s"""


@query(SESSION_SQL)
def player_sessions(v):
    return sessions.player_sessions(v.moves, "6 hours")
