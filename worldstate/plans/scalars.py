"""Queries for scalar functions and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from worldstate.functions import ids, spatial, terrain, text
from worldstate.functions.vectors import vec, vec_cross, vec_direction, vec_distance, vec_distance_sq, vec_dot, vec_normalize
from worldstate.operators import batching, feeds
from worldstate.plans.registry import query
from worldstate.sources.tables import shown_text, translations_long
from worldstate.operators.telemetry import translation_coverage as coverage


def r6(column):
    """Six decimals; adding zero turns -0.0 into 0.0."""
    return F.round(column, 6) + F.lit(0.0)


_CLEAN = r"regexp_replace(regexp_replace(raw, '[^a-zA-Z0-9- _éèàçùâêîôûäëïöüÿ]', '', 'g'), ' {2,}', ' ', 'g')"


@query(f"select id, {_CLEAN} as name from names")
def clean_player_name(v):
    return v.names.select("id", text.clean_player_name(F.col("raw")).alias("name"))


@query(
    f"""select id, case when trim(name) <> '' and length(name) >= 4 then substr(name, 1, 32) else 'nobody' end as accepted
    from (select id, {_CLEAN} as name from names) q"""
)
def accept_player_name(v):
    cleaned = text.clean_player_name(F.col("raw"))
    return v.names.select("id", text.accept_player_name(cleaned, "nobody").alias("accepted"))


def _bound(c: str) -> str:
    return f"case when abs({c}) = 10000000 then '∞' else cast({c} as varchar) end"


@query(
    "select id, 'Server zone'"
    + "".join(f" || ' | {a} ' || {_bound(a + '_start')} || ' -> ' || {_bound(a + '_end')}" for a in "xyz")
    + " || ' |' as label from zones"
)
def zone_label(v):
    return text.zone_label(v.zones).select("id", "label")


_COLOR = """case {t} when '0' then 'FFFFFF' when '5' then 'AAAAAA' when '2' then '27C8F5' when '3' then 'D327F5'
    when '4' then 'F7F3B5' when '1' then '79F25E' else substr(sha256({t}), 1, 6) end"""


@query(
    f"""select id, {_COLOR.format(t='raw')} as author_color, {_COLOR.format(t='chan')} as channel_color
    from (select id, raw, cast(id % 9 as varchar) as chan from names) q"""
)
def text_color(v):
    channel = (F.col("id") % 9).cast("string")
    return v.names.select(
        "id", text.text_color(F.col("raw")).alias("author_color"), text.text_color(channel).alias("channel_color")
    )


@query(
    """select seq_conv, turn, '[' || strftime(timestamp '2024-01-01' + to_seconds(seq_conv * 61 + turn), '%H:%M:%S') || '] : '
      || author || ' ' || case channel when 0 then '(GENERAL) ' when 1 then '(DIRECT_MESSAGE) ' when 2 then '(GROUP) '
      when 3 then '(ALLIANCE) ' when 4 then '(REGION) ' else '' end || content as line from chat"""
)
def format_chat_line(v):
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("seq_conv") * 61 + F.col("turn"))
    return text.format_chat_line(v.chat.withColumn("ts", at)).select("seq_conv", "turn", "line")


@query("select id, true as version_4 from names")
def with_uuid(v):
    """Random ids cannot be compared; their form can."""
    made = ids.with_uuid(v.names.select("id"))
    form = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    return made.select("id", F.col("uuid").rlike(form).alias("version_4"))


def _hex(*positions: int) -> str:
    return "('0x' || " + " || ".join(f"substr(h, {2 * i + 1}, 2)" for i in positions) + ")::bigint"


@query(
    f"""select id, {_hex(0, 1, 2, 3)} as low, {_hex(4, 5)} as mid, {_hex(6, 7)} as hi, {_hex(8, 9)} as clock,
      {_hex(10, 11, 12, 13, 14, 15)} as node, {_hex(3, 2, 1, 0)} as low_le, {_hex(5, 4)} as mid_le,
      {_hex(7, 6)} as hi_le, {_hex(9, 8)} as clock_le, {_hex(15, 14, 13, 12, 11, 10)} as node_le
    from (select id, md5(raw) as h from names) q"""
)
def uuid_fields(v):
    h = F.md5("raw")
    dashed = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    big = ids.uuid_fields(dashed)
    little = {f"{k}_le": c for k, c in ids.uuid_fields(dashed, big_endian=False).items()}
    return v.names.select("id", *[c.alias(k) for k, c in (big | little).items()])


@query(
    """select seq, round(sqrt((x-y)*(x-y) + (y-z)*(y-z) + (z-x)*(z-x)), 6) + 0.0e0 as dist,
      (x-y)*(x-y) + (y-z)*(y-z) + (z-x)*(z-x) as dist_sq, x*y + y*z + z*x as dot,
      y*x - z*z as cross_x, z*y - x*x as cross_y, x*z - y*y as cross_z,
      case when x=0 and y=0 and z=0 then 0e0 else round(x / sqrt(x*x + y*y + z*z), 6) + 0.0e0 end as unit_x,
      case when x=0 and y=0 and z=0 then 0e0 else round(-y / sqrt(x*x + y*y + z*z), 6) + 0.0e0 end as home_y
    from moves"""
)
def vector_maths(v):
    a, b = vec(), (F.col("y"), F.col("z"), F.col("x"))
    zero = (F.lit(0.0),) * 3
    cross = vec_cross(a, b)
    return v.moves.select(
        "seq",
        r6(vec_distance(a, b)).alias("dist"),
        vec_distance_sq(a, b).alias("dist_sq"),
        vec_dot(a, b).alias("dot"),
        *[c.alias(f"cross_{n}") for c, n in zip(cross, "xyz")],
        r6(vec_normalize(a)[0]).alias("unit_x"),
        r6(vec_direction(a, zero)[1]).alias("home_y"),
    )


@query("select seq, round(sqrt((x-y)*(x-y) + (y-z)*(y-z) + (z-x)*(z-x)), 6) + 0.0e0 as d from moves", name="vec_distance")
def distance_query(v):
    return v.moves.select("seq", r6(vec_distance(vec(), vec(names="yzx"))).alias("d"))


@query("select seq, (x-y)*(x-y) + (y-z)*(y-z) + (z-x)*(z-x) as d from moves", name="vec_distance_sq")
def distance_sq_query(v):
    return v.moves.select("seq", vec_distance_sq(vec(), vec(names="yzx")).alias("d"))


@query("select seq, x*y + y*z + z*x as d from moves", name="vec_dot")
def dot_query(v):
    return v.moves.select("seq", vec_dot(vec(), vec(names="yzx")).alias("d"))


@query("select seq, y*x - z*z as cx, z*y - x*x as cy, x*z - y*y as cz from moves", name="vec_cross")
def cross_query(v):
    crossed = vec_cross(vec(), vec(names="yzx"))
    return v.moves.select("seq", *[c.alias(f"c{a}") for c, a in zip(crossed, "xyz")])


_LENGTH = "sqrt(x*x + y*y + z*z)"


@query(
    "select seq, "
    + ", ".join(f"case when {_LENGTH} = 0 then 0e0 else round({a} / {_LENGTH}, 6) + 0.0e0 end as u{a}" for a in "xyz")
    + " from moves",
    name="vec_normalize",
)
def normalize_query(v):
    return v.moves.select("seq", *[r6(c).alias(f"u{a}") for c, a in zip(vec_normalize(vec()), "xyz")])


_TOWARDS = "sqrt((1-x)*(1-x) + (2-y)*(2-y) + (3-z)*(3-z))"


@query(
    "select seq, "
    + ", ".join(
        f"case when {_TOWARDS} = 0 then 0e0 else round(({n}-{a}) / {_TOWARDS}, 6) + 0.0e0 end as u{a}" for n, a in enumerate("xyz", 1)
    )
    + " from moves",
    name="vec_direction",
)
def direction_query(v):
    target = (F.lit(1.0), F.lit(2.0), F.lit(3.0))
    return v.moves.select("seq", *[r6(c).alias(f"u{a}") for c, a in zip(vec_direction(vec(), target), "xyz")])


@query(
    """select seq, (value <> last_value or x <> last_x) and (floor(value) <> last_value or floor(x) <> last_x) as moved
    from (select seq, value, x, floor(value) + case when seq % 3 = 0 then 1 else 0 end as last_value, x as last_x
      from moves) q"""
)
def moved_whole_unit(v):
    last = F.floor("value").cast("double") + F.when(F.col("seq") % 3 == 0, 1.0).otherwise(0.0)
    moved = spatial.moved_whole_unit([F.col("value"), F.col("x")], [last, F.col("x")])
    return v.moves.select("seq", moved.alias("moved"))


@query("select uid, x*100 as x, y*100 as y, z*100 as z from nodes")
def scale_coordinates(v):
    return spatial.scale_coordinates(v.nodes).select("uid", "x", "y", "z")


_CAT = "case when size <= 0.5 then 0 when size <= 2 then 1 when size <= 8 then 2 else 3 end"


@query(f"select uid, cast({_CAT} as int) as size_cat from nodes")
def size_category(v):
    return v.nodes.select("uid", spatial.size_category(F.col("size")).alias("size_cat"))


@query(
    """select uid, cast(trunc(x / edge) as bigint) as cx, cast(trunc(z / edge) as bigint) as cz
    from (select *, case when size <= 0.5 then 8e0 when size <= 2 then 16e0 when size <= 8 then 64e0
      else 9999999999999e0 end as edge from nodes) q"""
)
def chunk_position(v):
    cx, cz = spatial.chunk_position(F.col("x"), F.col("z"), spatial.size_category(F.col("size")))
    return v.nodes.select("uid", cx.alias("cx"), cz.alias("cz"))


_CELL = ", ".join(f"cast(trunc({a} / 300e0) as bigint) as c{a}" for a in "xyz")


@query(f"select seq, {_CELL} from moves")
def cell_of_position(v):
    cells = spatial.cell_of_position(*vec())
    return v.moves.select("seq", *[c.alias(f"c{a}") for c, a in zip(cells, "xyz")])


@query(
    f"""select seq, xor(xor(cx*73856093, cy*19349663), cz*83492791) as seed
    from (select seq, {_CELL} from moves) q"""
)
def cell_seed(v):
    return v.moves.select("seq", spatial.cell_seed(*spatial.cell_of_position(*vec())).alias("seed"))


def _layer(noise: str, amplitude: str, low: str, high: str) -> str:
    return f"greatest(least(({noise} + 0.5e0) * {amplitude}, {high}), {low})"


_ELEVATION = " + ".join(
    (
        _layer("macro", "300e0", "300e0", "350e0"),
        _layer("macro", "270e0", "350e0", "1000e0"),
        _layer("micro", "10e0", "0e0", "10000e0"),
    )
)


@query(
    f"""select uid, round({_ELEVATION}, 6) as elevation, round(2000e0 + ({_ELEVATION}) * 0.5e0, 6) as height
    from (select uid, x/1000 as macro, z/1000 as micro from nodes) q"""
)
def terrain_elevation(v):
    elevation = terrain.terrain_elevation({"macro": F.col("x") / 1000, "micro": F.col("z") / 1000})
    return v.nodes.select("uid", r6(elevation).alias("elevation"), r6(F.lit(2000.0) + elevation * 0.5).alias("height"))


FACE_SQL = """(values (0, 0e0,0e0,-1e0), (1, 1e0,0e0,0e0), (2, -1e0,0e0,0e0), (3, 0e0,0e0,1e0), (4, 0e0,1e0,0e0),
    (5, 0e0,-1e0,0e0)) f(face, nx, ny, nz)"""
# axisA = (ny, nz, nx); axisB = n × axisA
PLANE_SQL = """nx + {u}*ny + {v}*(ny*nx - nz*nz) as px, ny + {u}*nz + {v}*(nz*ny - nx*nx) as py,
    nz + {u}*nx + {v}*(nx*nz - ny*ny) as pz"""


@query(
    f"""select uid, {", ".join(f"round({p} / sqrt(px*px + py*py + pz*pz) * 1000, 6) + 0.0e0 as s{p[1]}" for p in ("px", "py", "pz"))}
    from (select uid, {PLANE_SQL.format(u='u', v='v')} from
      (select uid, cast(floor(y) as int) % 6 as face, x/1000 as u, z/1000 as v from nodes) q
      join {FACE_SQL} using (face)) p"""
)
def cube_to_sphere(v):
    face = F.floor("y").cast("int") % 6
    place = terrain.cube_to_sphere(face, F.col("x") / 1000, F.col("z") / 1000, 1000.0)
    return v.nodes.select("uid", *[r6(p).alias(f"s{a}") for p, a in zip(place, "xyz")])


def draw_sql(*parts: str) -> str:
    """A hashed draw in [0, 1) of the parts' texts."""
    return f"(('0x' || substr(md5(concat_ws(',', {', '.join(parts)})), 1, 13))::bigint / 4503599627370496e0)"


@query(
    """select id, round(cx + sin(phi)*cos(theta)*(radius+1), 6) + 0e0 as px, round(cy + sin(phi)*sin(theta)*(radius+1), 6) + 0e0 as py,
      round(cz + cos(phi)*(radius+1), 6) + 0e0 as pz
    from (select *, %s * (2*pi()) as theta, acos(1e0 - %s * 2) as phi from fields) q"""
    % (draw_sql("id", "1"), draw_sql("id", "2"))
)
def point_on_sphere(v):
    centre = (F.col("cx"), F.col("cy"), F.col("cz"))
    placed = terrain.point_on_sphere(v.fields, ["id"], centre, F.col("radius"))
    return placed.select("id", *[r6(F.col(f"p{a}")).alias(f"p{a}") for a in "xyz"])


@query(
    """select seq, cast(pos as int) as pos, cast(json_extract_string(element, '$.id') as bigint) as id
    from (select seq, generate_subscripts(items, 1) - 1 as pos, unnest(items) as element from (
      select seq, case when json_type(json_data) = 'ARRAY' then json_extract(json_data, '$[*]')
        else [json_data::json] end as items from payloads where json_valid(json_data)) a) b"""
)
def combine_operations(v):
    flat = batching.combine_operations(v.payloads)
    return flat.select("seq", "pos", F.get_json_object("element", "$.id").cast("bigint").alias("id"))


@query("select seq, json_data from payloads where not json_valid(json_data)")
def malformed_operations(v):
    return batching.malformed_operations(v.payloads)


@query("select seq, server_id, op from moves where server_id <> 3")
def local_remote(v):
    return feeds.local_remote(v.moves, 3).select("seq", "server_id", "op")


@query(
    """select seq, topic, case topic when 'chat/GENERAL' then 'chat' when 'sdo/serverslist' then 'zone_snapshot'
      when 'sdo/playerschanges' then 'player_changes' when 'sdo/propschanges' then 'prop_changes' end as handler
    from feed_topics"""
)
def route_topics(v):
    return feeds.route_topics(v.feed_topics)


@query(
    """select locale, count(txt) as present, count(*) - count(txt) as missing, count(txt) / count(*) as ratio
    from (select 'en' as locale, en as txt from translations union all select 'fr', fr from translations
      union all select 'es', es from translations) q group by locale"""
)
def translation_coverage(v):
    wide = v.translations.withColumnRenamed("k", "key")
    return coverage(translations_long(wide, ["en", "fr", "es"]))


@query(
    """select k as key, locale, coalesce(txt, k) as shown
    from (select k, 'en' as locale, en as txt from translations union all select k, 'fr', fr from translations
      union all select k, 'es', es from translations) q"""
)
def translations_shown(v):
    wide = v.translations.withColumnRenamed("k", "key")
    return shown_text(translations_long(wide, ["en", "fr", "es"])).select("key", "locale", "shown")
