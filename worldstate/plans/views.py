"""Derived views over the test tables, one text for both SQL engines.

``{JSON}``, ``{STR}`` and table names are filled in per engine. Views refer to one another by
name; ``cte`` collects those a query needs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

VIEWS: dict[str, str] = {
    "moves": """
        select event_id as seq, ts, user_id as entity_id, cast(user_id % 25 as int) as server_id,
          case event_type when 'signup' then 'add' when 'error' then 'delete' else 'update' end as op,
          case event_id % 3 when 0 then 'box50cm' when 1 then 'box4m' else 'ship' end as prop_type, value,
          cast((user_id*104729 + (k % 3)*7919) % 20001 - 10000 as double) as x,
          cast((user_id*15485863 + (k % 3)*31) % 2001 - 1000 as double) as y,
          cast((user_id*32452843 + (k % 3)*104729) % 20001 - 10000 as double) as z
        from (select *, cast({JSON} as bigint) as k from {events}) e""",
    "zones": """
        select n_nationkey as id, n_name as name, n_nationkey as seq,
          (n_nationkey % 5)*4000.0e0 - 10000 as x_start, (n_nationkey % 5)*4000.0e0 - 6000 as x_end,
          -10000000.0e0 as y_start, 10000000.0e0 as y_end,
          cast(floor(n_nationkey/5.0e0) as int)*4000.0e0 - 10000 as z_start,
          cast(floor(n_nationkey/5.0e0) as int)*4000.0e0 - 6000 as z_end
        from {nation}""",
    "nodes": """
        select concat('n', cast(p_partkey as {STR})) as uid,
          case when p_partkey=0 then '' else concat('n', cast(cast(floor((p_partkey-1)/4.0e0) as bigint) as {STR})) end
            as parent_uid,
          p_type as scene, p_name as name, p_size/5.0e0 as size,
          cast((p_partkey*7919) % 2001 - 1000 as double) as x, cast(p_partkey % 17 as double) as y,
          cast((p_partkey*104729) % 2001 - 1000 as double) as z
        from {part}""",
    "ops": """
        select o_orderkey as seq, cast(o_custkey % 25 as int) as server_id, o_orderdate as ts,
          cast(substr(o_orderpriority,1,1) as int)-1 as priority,
          case when o_orderstatus='F' then 'Deletion' else 'Mutation' end as kind,
          (o_orderkey*7919) % 10 = 0 as failed
        from {orders}""",
    "latest": """
        select entity_id, server_id, op, x, y, z
        from (select *, row_number() over (partition by entity_id order by ts desc, seq desc) rn from moves) q
        where rn=1 and op<>'delete'""",
    "entities": """
        select concat('r', cast(r_regionkey as {STR})) as uid, r_name as name, '' as parent_uid, 'Planete' as type_obj
        from {region}
        union all select concat('n', cast(n_nationkey as {STR})), n_name, concat('r', cast(n_regionkey as {STR})),
          'station' from {nation}
        union all select concat('c', cast(c_custkey as {STR})), c_name, concat('n', cast(c_nationkey as {STR})),
          'box4m' from {customer}
        union all select concat('o', cast(o_orderkey as {STR})), concat('order ', o_orderpriority),
          concat('c', cast(o_custkey as {STR})), 'box50cm' from {orders}""",
    "chat": """
        select conv_id as seq_conv, turn, role as author, cast(conv_id % 6 as int) as channel, text as content
        from {conversations}""",
    "names": "select doc_id as id, text as raw from {documents}",
    "fields": """
        select s_suppkey as id, s_name as name, cast((s_suppkey*7919) % 20001 - 10000 as double) as cx, 0e0 as cy,
          cast((s_suppkey*104729) % 20001 - 10000 as double) as cz,
          cast(500 + s_suppkey % 7 * 300 as double) as radius, 120e0 as atmosphere
        from {supplier}""",
    "config_updates": """
        select ts, event_id as seq, cast(event_id % 20 + 2 as int) as max_players
        from {events} where event_type='purchase'""",
    "membership": """
        select event_id as seq, ts, user_id as entity_id, cast(event_id % 5 as int) as area_id,
          case when event_type in ('view','signup') then 'enter' else 'exit' end as kind
        from {events}""",
    "diff_left": "select c_custkey as k, c_name as name, c_acctbal as bal from {customer} where c_custkey % 13 <> 0",
    "diff_right": """
        select c_custkey as k, c_name as name,
          case when c_custkey % 10 = 0 then c_acctbal + 1 else c_acctbal end as bal
        from {customer} where c_custkey % 17 <> 0""",
    "test_results": """
        select concat('script', cast(doc_id % 20 as {STR})) as script, doc_id as test_id, doc_id % 11 <> 0 as was_run,
          doc_id % 23 = 0 as should_skip, cast(quality as int) as pass_n, cast(toxic as int) as fail_n,
          case when doc_id % 7 = 0 then 1 else 0 end as pending_n, cast(doc_id % 100 as double)/10 as time_taken
        from {labels}""",
    "translations": """
        select part_type as k, min(case when b=0 then nm end) as en, min(case when b=1 then nm end) as fr,
          min(case when b=2 then nm end) as es
        from (select p_brand as part_type, p_partkey % 4 as b, p_name as nm from {part}) q
        group by part_type""",
    # players placed on the server whose zone holds them; zones lie on a grid of 5 by 5
    "homed": """
        select l.entity_id, z.id as server_id, l.x, l.y, l.z
        from latest l join zones z
          on z.id = cast(floor((l.x + 10000)/4000.0e0) as int) + 5*cast(floor((l.z + 10000)/4000.0e0) as int)
          and l.x >= z.x_start and l.x < z.x_end and l.z >= z.z_start and l.z < z.z_end""",
    # the same, but players just signed up are still with the server they signed up on
    "settling": """
        select l.entity_id, case when l.op = 'add' then l.server_id else z.id end as server_id, l.x, l.y, l.z
        from latest l join zones z
          on z.id = cast(floor((l.x + 10000)/4000.0e0) as int) + 5*cast(floor((l.z + 10000)/4000.0e0) as int)
          and l.x >= z.x_start and l.x < z.x_end and l.z >= z.z_start and l.z < z.z_end""",
    # zones with split and merge orders
    "ordered_zones": """
        select z.*, case when n.n_regionkey = 1 then z.id + 1 end as to_split_server_id,
          case when n.n_regionkey = 3 then z.id - 1 end as to_merge_server_id
        from zones z join {nation} n on n.n_nationkey = z.id""",
    # spawn places: on a planet (a field) or at a station with its own up vector
    "spawns": """
        select id as idx, id as body_id, case when id % 3 = 2 then 'station' else 'planet' end as kind,
          cx + radius as x, 10e0 as y, cz - 5e0 as z, 0e0 as up_x, 0e0 as up_y, 1e0 as up_z
        from fields""",
    "spawn_requests": "select c_custkey as player_id, c_custkey - 5 as spawn_point, c_nationkey as server_id from {customer}",
    # operation payloads: objects, arrays, and texts that are no JSON
    "payloads": """
        select o_orderkey as seq,
          case when o_orderkey % 31 = 0 then concat('{{"id": ', cast(o_orderkey as {STR}))
            when o_orderkey % 3 = 0 then concat('[{{"id":', cast(o_orderkey as {STR}), '}},{{"id":',
              cast(o_custkey as {STR}), '}}]')
            else concat('{{"id":', cast(o_orderkey as {STR}), '}}') end as json_data
        from {orders}""",
    # delivery attempts of batches, four orders to a batch
    "attempts": """
        select cast(floor(o_orderkey/4.0e0) as bigint) as batch_no, cast(o_custkey % 25 as int) as server_id,
          o_orderkey as seq, o_orderkey*7919 % 10 < 6 as failed,
          case when o_orderstatus='F' then 'Deletion' else 'Mutation' end as kind
        from {orders}""",
    # tile shapes and focus points for distance classes
    "shapes": "select uid, x*10 as x, y as y, z*10 as z from nodes",
    "feed_topics": """
        select event_id as seq, case event_type when 'signup' then 'sdo/serverslist' when 'error' then 'chat/GROUP'
          when 'click' then 'sdo/playerschanges' when 'view' then 'chat/GENERAL' else 'sdo/propschanges' end as topic
        from {events}""",
    # one delivery result per save request
    "save_log": """
        select o_orderkey as request_id, concat('0x', cast(o_custkey as {STR})) as uid,
          case when o_orderstatus = 'F' then ''
            when o_orderpriority = '1-URGENT' then concat('0x', cast(o_custkey + 1 as {STR}))
            else concat('0x', cast(o_custkey as {STR})) end as new_uid,
          o_orderpriority = '5-LOW' as is_new, o_orderstatus <> 'P' as success
        from {orders}""",
    # server telemetry samples
    "samples": """
        select ts, event_id as seq, cast(user_id % 25 as int) as server_id, cast(floor(value*100) as bigint) as memory,
          cast(event_id % 977 as bigint) as numberobjects, cast(20 + event_id % 11 as bigint) as timefps,
          cast(user_id % 40 as bigint) as currentplayers
        from {events}""",
    # cameras wander in steps of up to a few units
    "camera": """
        select event_id as seq, ts, user_id as camera_id, cast((event_id*7919) % 13 as double)/10 + user_id as x,
          cast((event_id*104729) % 7 as double)/10 as y, cast((event_id*31) % 11 as double)/10 as z
        from {events}""",
}


def _references(text: str) -> list[str]:
    return [name for name in VIEWS if re.search(rf"(?<![\w.{{]){name}(?![\w}}])", text)]


def cte(text: str, dialect: str, folder: str = "") -> str:
    """``text`` preceded by the views it needs, for ``spark`` or ``duckdb``."""
    needed: list[str] = []

    def visit(name: str) -> None:
        if name in needed:
            return
        for other in _references(VIEWS[name]):
            if other != name:
                visit(other)
        needed.append(name)

    for name in _references(text):
        visit(name)
    if dialect == "spark":
        fill = {t: f"parquet.`{folder}/{t}.parquet`" for t in TABLES}
        fill |= {"JSON": "get_json_object(props,'$.k')", "STR": "string"}
    else:
        fill = {t: t for t in TABLES} | {"JSON": "json_extract_string(props,'$.k')", "STR": "varchar"}
    views = [f"{name} as ({VIEWS[name].format(**fill)})" for name in needed]
    body = text.format(**fill) if dialect == "spark" else text
    if not views:
        return body
    body = body.strip()
    if body.lower().startswith("with recursive"):
        return "with recursive " + ",\n".join(views) + ",\n" + body[len("with recursive") :]
    if body.lower().startswith("with"):
        return "with " + ",\n".join(views) + ",\n" + body[len("with") :]
    return "with " + ",\n".join(views) + "\n" + body


class Views:
    """The derived views as DataFrames: ``Views(spark, folder).moves``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.spark.sql(cte(f"select * from {name}", "spark", self.folder))
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        raise AttributeError(name)
