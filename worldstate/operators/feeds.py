"""Change feeds: envelopes with add / update / delete lists, replay and delta detection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worldstate.operators.ordered import ROWS_PER_TASK, Ordered, last_row, order_value
from worldstate.session import cut_lineage

OPS = ("add", "update", "delete")

# fixed values: topics with a handler; all other topics are rejected
HANDLERS = {
    "chat/GENERAL": "chat",
    "sdo/serverslist": "zone_snapshot",
    "sdo/serverschanges": "zone_changes",
    "sdo/playerslist": "player_snapshot",
    "sdo/playerschanges": "player_changes",
    "sdo/propschanges": "prop_changes",
    "sdo/variableschanges": "config_changes",
}
# fixed values: publish periods in ticks (a counter of n fires every n + 1 ticks), tick rate
PLAYER_TICKS, ZONE_CHECK_TICKS, METRIC_TICKS, OVERLOAD_TICKS = 16, 21, 121, 3601
TICK_RATE = 30


def parse_change_feed(
    df: DataFrame, entity_schema: str, payload: str = "payload", server_type: str = "int"
) -> DataFrame:
    """One row per entity of each envelope: kept columns, ``server_id, op, pos``, entity fields.

    Whole numbers in the JSON may be written as 1 or 1.0. Texts that are no envelope give no rows,
    a value that is no whole number gives null; ``rejected_envelopes`` returns both kinds.
    """
    fields = T.StructType.fromDDL(entity_schema).fields
    kept = [c for c in df.columns if c != payload]
    values = [_whole(F.col(f"entity.{f.name}"), f.dataType).alias(f.name) if _is_whole(f) else F.col(f"entity.{f.name}") for f in fields]
    return (
        df.withColumn("_e", F.from_json(payload, _envelope(fields)))
        .select(*kept, F.col("_e.server_id").cast(server_type).alias("server_id"), F.inline(_entities(fields)))
        .select(*kept, "server_id", "op", "pos", *values)
    )


def _is_whole(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.IntegralType)


def _envelope(fields: Sequence[T.StructField]) -> T.StructType:
    """Whole-number fields are read as text, so that no digit is lost and bad ones can be told."""
    entity = T.StructType([T.StructField(f.name, T.StringType() if _is_whole(f) else f.dataType) for f in fields])
    lists = [T.StructField(op, T.ArrayType(entity)) for op in OPS]
    return T.StructType([*lists, T.StructField("server_id", T.DoubleType())])


def _entities(fields: Sequence[T.StructField]) -> Column:
    none = F.array().cast(_envelope(fields)[OPS[0]].dataType)

    def tagged(op: str) -> Column:
        listed = F.coalesce(F.col(f"_e.{op}"), none)
        return F.transform(listed, lambda e, i: F.struct(F.lit(op).alias("op"), i.alias("pos"), e.alias("entity")))

    return F.concat(*[tagged(op) for op in OPS])


def _whole(text: Column, kind: T.DataType) -> Column:
    number = text.try_cast("decimal(38,6)")
    return F.when(number == F.floor(number), number).try_cast(kind)


def rejected_envelopes(df: DataFrame, payload: str = "payload", entity_schema: str | None = None) -> DataFrame:
    """Payloads that are not JSON objects and, with the schema, those with a value in a whole-number
    field that is none."""
    bad = F.json_object_keys(F.col(payload)).isNull()
    if entity_schema is None:
        return df.filter(bad)
    fields = T.StructType.fromDDL(entity_schema).fields

    def lost(item: Column) -> Column:
        out = F.lit(False)
        for f in filter(_is_whole, fields):
            text = item["entity"][f.name]
            out = out | (text.isNotNull() & _whole(text, f.dataType).isNull())
        return out

    read = df.withColumn("_e", F.from_json(payload, _envelope(fields)))
    return read.filter(bad | F.exists(_entities(fields), lost)).select(*df.columns)


def publish_change_feed(
    df: DataFrame,
    tick: str,
    order: Sequence[str],
    entity: Sequence[str],
    server: str = "server_id",
    op: str = "op",
    max_entities: int = 10_000,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Envelopes ``(server, tick, part, payload)``; ticks without changes give none.

    A busy server's tick is spread over several envelopes of ``max_entities`` rows, so that no
    message, and no task, holds an unbounded list. Applied in part order they equal one envelope.
    """
    rows = Ordered(df, [server, tick], order, rows_per_task).row_number("_n").result()
    part = F.floor((F.col("_n") - 1) / max_entities).cast("int")

    def branch(name: str) -> Column:
        item = F.when(F.col(op) == name, F.struct("_n", F.struct(*entity).alias("e")))
        return F.transform(F.sort_array(F.collect_list(item)), lambda s: s["e"]).alias(name)

    grouped = rows.groupBy(server, tick, part.alias("part")).agg(*[branch(name) for name in OPS])
    body = F.struct(*OPS, F.col(server).alias("server_id"))
    return grouped.select(
        server, tick, "part", *[F.size(n).alias(f"n_{n}") for n in OPS], F.to_json(body).alias("payload")
    )


def local_remote(df: DataFrame, server_id: int, server: str = "server_id") -> DataFrame:
    """Rows of other servers; a server ignores its own changes."""
    return df.filter(F.col(server) != server_id)


def route_topics(df: DataFrame, topic: str = "topic") -> DataFrame:
    """Adds ``handler``; null marks a rejected topic."""
    handlers = F.create_map(*[F.lit(v) for pair in HANDLERS.items() for v in pair])
    return df.withColumn("handler", F.try_element_at(handlers, F.col(topic)))


def moved_since_last(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    in_transfer: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Rows whose position or rotation differs from the last published one; zeros come first.

    Entities in transfer are not published. Equal rows change nothing, so the last published
    values are those of the row before.
    """
    if in_transfer is not None:
        df = df.join(in_transfer.select(*keys).distinct(), list(keys), "left_anti")
    rows = Ordered(df, keys, order, rows_per_task).lag("_last", F.struct(*values)).result()
    changed = F.lit(False)
    for v in values:
        changed = changed | ~F.col(v).eqNullSafe(F.coalesce(F.col(f"_last.{v}"), F.when(F.col("_last").isNull(), 0.0)))
    return rows.filter(changed).drop("_last")


def tick_sample(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    period_ticks: int = PLAYER_TICKS,
    rate: int = TICK_RATE,
) -> DataFrame:
    """At most one row per key and period, the latest; ``bucket`` numbers the periods."""
    ticks = order_value(df, order[0]).cast("bigint") * rate
    timed = df.withColumn("_t", ticks).withColumn("bucket", F.expr(f"_t div {period_ticks * 1_000_000}L")).drop("_t")
    return last_row(timed, [*keys, "bucket"], order)


def latest_state(df: DataFrame, keys: Sequence[str], order: Sequence[str], op: str = "op") -> DataFrame:
    """Current row per key; keys whose last change is a delete are gone."""
    return last_row(df, keys, order).filter(F.col(op) != "delete")


def merge_partial_updates(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str], op: str = "op"
) -> DataFrame:
    """Current row per key when updates may carry only some fields.

    A field keeps its last given value since the latest delete; a delete forgets the row.
    """
    position = F.struct(*order)
    deleted = df.filter(F.col(op) == "delete").groupBy(*keys).agg(F.max(position).alias("_gone"))
    alive = df.filter(F.col(op) != "delete").join(deleted, list(keys), "left")
    alive = alive.filter(F.col("_gone").isNull() | (position > F.col("_gone")))
    return alive.groupBy(*keys).agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), position)).alias(f) for f in fields]
    )


def newer_changes(changes: DataFrame, versions: DataFrame, sender: str, version: str) -> DataFrame:
    """Changes beyond what a snapshot already holds of their sender; for a table or a stream.

    ``versions`` has one row per sender: the last ``version`` the snapshot knows of it. Senders it doesn't
    know, and changes without a sender or version, pass.
    """
    known = versions.select(F.col(sender).alias("_sender"), F.col(version).alias("_known"))
    joined = changes.join(known, F.col(sender) == F.col("_sender"), "left")
    return joined.filter(F.col("_known").isNull() | F.col(version).isNull() | (F.col(version) > F.col("_known"))).drop("_sender", "_known")


def change_gaps(
    changes: DataFrame, versions: DataFrame, sender: str, version: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """``sender, after, missing``: runs of versions that never came; repeats count once."""
    newer = newer_changes(changes, versions, sender, version).filter(F.col(sender).isNotNull() & F.col(version).isNotNull())
    seen = newer.select(sender, version).union(versions.select(sender, version)).distinct()
    scan = Ordered(seen, [sender], [version], rows_per_task).lead("_next", F.col(version)).result()
    missing = F.col("_next") - F.col(version) - 1
    return scan.filter(missing > 0).select(sender, F.col(version).alias("after"), missing.alias("missing"))


def snapshot_then_changes(
    snapshot: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str], op: str = "op",
    versions: DataFrame | None = None, sender: str = "server_id", version: str = "version",
) -> DataFrame:
    """Current rows from one snapshot followed by its later changes.

    The snapshot rows carry the same columns; they count as adds made before every change. With ``versions`` (the
    snapshot's last version of each sender) changes that the snapshot already holds are dropped, so an old change
    that comes again does not win.
    """
    if versions is not None:
        changes = newer_changes(changes, versions, sender, version)
    first = snapshot.withColumn(op, F.lit("add")).withColumn("_age", F.lit(0))
    rest = changes.withColumn("_age", F.lit(1))
    both = first.unionByName(rest, allowMissingColumns=versions is not None)
    return latest_state(both, keys, ["_age", *order], op).drop("_age")


def config_in_effect(
    events: DataFrame,
    updates: DataFrame,
    order: Sequence[str],
    variables: Sequence[str],
    keys: Sequence[str] = (),
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """As-of join: each event with the last value of every variable at its time.

    At equal ``order`` values the update counts first. Only the updates are put in order. Each is an interval up to the
    next one; a key's time is cut into as many buckets as it has updates, so its intervals lie in twice as many
    (bucket, interval) rows at most, and an event meets those of its bucket by an equi join. Events stay where
    they are as long as Spark can broadcast the intervals, else both sides are dealt by key and bucket.
    """
    own = list(keys) or ["_all"]
    everyone = {} if keys else {"_all": F.lit(0)}
    known = updates.select(*keys, *order, *variables).withColumns(everyone)
    scan = Ordered(known, own, order, rows_per_task)
    for v in variables:
        scan = scan.last_known(v, F.col(v))
    scan = scan.lead("_until", F.struct(*order)).result().withColumn("_since", F.struct(*order))
    at = order_value(updates, order[0])
    scan = scan.withColumn("_from", at)
    span = scan.groupBy(*own).agg(F.min("_from").alias("_t0"), F.max("_from").alias("_t1"), F.count(F.lit(1)).alias("_n"))
    width = F.greatest((F.col("_t1") - F.col("_t0")) / F.col("_n"), F.lit(1e-9))
    span = cut_lineage(span.select(*own, "_t0", width.alias("_w"), "_n"), "spans")

    def bucket(value: Column) -> Column:
        return F.least(F.greatest(F.floor((value - F.col("_t0")) / F.col("_w")), F.lit(0)), F.col("_n"))

    until = order_value(scan.select(F.col(f"_until.{order[0]}").alias("u")), "u")
    placed = scan.join(span, own).withColumn("u", F.col(f"_until.{order[0]}")).withColumn("_last", F.coalesce(bucket(until), F.col("_n")))
    intervals = placed.select(*[F.col(c).alias(f"_k_{c}") for c in own], "_since", "_until", *variables, F.explode(F.sequence(bucket(F.col("_from")), "_last")).alias("_bucket"))
    left = events.drop(*variables).withColumns(everyone).join(span, own, "left")
    left = left.withColumn("_at", bucket(order_value(events, order[0]))).drop("_t0", "_w", "_n")
    here = F.struct(*order)
    same = F.col("_at") == F.col("_bucket")
    for c in own:
        same = same & (F.col(c) == F.col(f"_k_{c}"))
    met = left.join(intervals, same & (here >= F.col("_since")) & (F.col("_until").isNull() | (here < F.col("_until"))), "left")
    return met.select(*[c for c in events.columns if c not in variables], *variables)


def keep_last_messages(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 50) -> DataFrame:
    """The last ``n`` rows per key; Spark keeps only n per key and task before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n).drop("_rank")
