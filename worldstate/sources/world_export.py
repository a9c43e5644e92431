"""World exports: indented, pipe-separated text, one line per node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worldstate.functions.text import number_text
from worldstate.operators.hierarchy import hierarchy_paths
from worldstate.operators.ranges import states
from worldstate.session import cut_lineage
from worldstate.sources.lines import numbered_lines

MIN_FIELDS = 6
BLOCK = 128  # lines folded as one array; a fold costs the square of its length
GROUP = 8  # blocks of a group, as a multiple of BLOCK
_TRIPLES = (("position", ""), ("rotation", "r"), ("scale", "s"))


def read_world_export(
    spark: SparkSession, path: str, one_text: bool = False, rows_per_task: int = BLOCK
) -> DataFrame:
    """Nodes of the exports at ``path``: file, line_no, depth, uid, parent_uid, scene, places, size, properties.

    The parent is the nearest earlier line of smaller depth in the same text; lines with fewer
    than six fields are dropped first. ``one_text``: the parts in a folder form one text. ``rows_per_task``:
    lines that are folded as one array.
    """
    lines = numbered_lines(spark, path, one_text)
    fields = F.split(F.trim(F.col("value"), F.lit("\t \r")), r"\|")
    parsed = (
        lines.withColumn("depth", F.length(F.regexp_extract("value", "^\t*", 0)))
        .withColumn("_f", fields)
        .filter(F.size("_f") >= MIN_FIELDS)
    )

    def number(text: Column) -> Column:
        return F.coalesce(text.try_cast("double"), F.lit(0.0))

    columns = {"uid": F.get("_f", F.lit(0)), "scene": F.regexp_replace(F.trim(F.get("_f", F.lit(1))), '^"|"$', "")}
    for i, (_, prefix) in enumerate(_TRIPLES, start=2):
        parts = F.split(F.get("_f", F.lit(i)), ",")
        columns |= {f"{prefix}{a}": number(F.get(parts, F.lit(k))) for k, a in enumerate("xyz")}
    columns["size"] = number(F.get("_f", F.lit(5)))
    columns["properties"] = F.to_json(
        F.coalesce(F.try_parse_json(F.get("_f", F.lit(6))), F.parse_json(F.lit("{}")))
    )
    nodes = parsed.withColumns(columns).drop("_f", "value")
    return _with_parents(nodes, rows_per_task)


def _push(above: Column, line: Column) -> Column:
    """Open lines after ``line``: those above that are shallower, then the line itself."""
    return F.array_append(F.filter(above, lambda o: o["depth"] < line["depth"]), line)


def _join(above: Column, part: Column) -> Column:
    """Open lines after a part whose own open lines are ``part``; its first is its shallowest line."""
    return F.concat(F.filter(above, lambda o: o["depth"] < F.get(part, F.lit(0))["depth"]), part)


def _before(items: str, entering: Column, step) -> Column:
    """What is open before each of ``items``."""
    return F.slice(F.concat(F.array(entering), states(F.col(items), entering, step)), F.lit(1), F.size(items))


def _with_parents(nodes: DataFrame, block: int) -> DataFrame:
    """Nearest earlier line of smaller depth, by the stack of lines that are open.

    A block of lines changes the stack as a whole: its first line's depth closes what is deeper, its own open lines come
    on top. Such stacks join within groups of ``GROUP * block`` blocks, and groups within a file, so each block knows
    what is open where it begins. The plan is the same for any depth. Arrays hold the lines of a block, the blocks of a
    group, or the groups of a file (of 131,072 lines each, so 8,000 in a text of a thousand million lines).
    """
    nothing = F.array().cast("array<struct<line_no:bigint,depth:int,uid:string>>")
    lines = F.array_sort(F.collect_list(F.struct("line_no", "depth", "uid"))).alias("lines")
    blocks = nodes.groupBy("file", F.expr(f"line_no div {block}").alias("_block")).agg(lines)
    blocks = cut_lineage(blocks.withColumn("open", F.aggregate("lines", nothing, _push)), "export-blocks")
    parts = F.array_sort(F.collect_list(F.struct("_block", "open"))).alias("blocks")
    groups = blocks.groupBy("file", F.expr(f"_block div {GROUP * block}").alias("_group")).agg(parts)
    whole = F.aggregate("blocks", nothing, lambda above, part: _join(above, part["open"]))
    groups = cut_lineage(groups.withColumn("open", whole), "export-groups")
    files = groups.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("_group", "open"))).alias("groups"))

    def joined(above: Column, part: Column) -> Column:
        return _join(above, part["open"])

    def opened(rows: DataFrame, items: str, entering: Column, key: str) -> DataFrame:
        pairs = F.arrays_zip(F.transform(items, lambda i: i[key]).alias(key), _before(items, entering, joined).alias("above"))
        return rows.select("file", F.explode(pairs).alias("p")).select("file", f"p.{key}", "p.above")

    of_groups = opened(files, "groups", nothing, "_group")
    of_blocks = opened(groups.join(of_groups, ["file", "_group"]), "blocks", F.col("above"), "_block")
    stacks = states(F.col("lines"), F.col("above"), _push)
    pairs = F.arrays_zip(
        F.transform("lines", lambda line: line["line_no"]).alias("line_no"),
        F.transform(stacks, lambda held: F.get(held, F.size(held) - 2)["uid"]).alias("parent"),
    )
    found = blocks.join(of_blocks, ["file", "_block"]).select("file", F.explode(pairs).alias("p"))
    return nodes.join(found.select("file", "p.line_no", "p.parent"), ["file", "line_no"]).select(
        "file", "line_no", "depth", "uid", F.coalesce("parent", F.lit("")).alias("parent_uid"),
        "scene", "x", "y", "z", "rx", "ry", "rz", "sx", "sy", "sz", "size", "properties",
    )


def world_export_lines(nodes: DataFrame) -> DataFrame:
    """``path, value``: export lines of all nodes that hang below a root."""
    placed = hierarchy_paths(nodes)
    triples = [F.concat_ws(",", *[number_text(F.col(f"{p}{a}")) for a in "xyz"]) for _, p in _TRIPLES]
    props = F.coalesce(F.col("properties"), F.lit("{}")) if "properties" in nodes.columns else F.lit("{}")
    line = F.concat_ws("|", "uid", F.concat(F.lit('"'), "scene", F.lit('"')), *triples, number_text(F.col("size")), props)
    return placed.select("path", F.concat(F.repeat(F.lit("\t"), F.col("depth")), line).alias("value"))


def write_world_export(nodes: DataFrame, path: str) -> None:
    """Write nodes depth first, siblings by uid, as text parts that continue one another.

    Nodes below a missing parent are not written. Read back with ``one_text=True``.
    """
    world_export_lines(nodes).orderBy("path").select("value").write.text(path)
