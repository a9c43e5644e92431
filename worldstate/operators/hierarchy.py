"""Parent/child trees: paths, order, subtrees, orphans, merged bounds."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worldstate.operators.ordered import number_in_order
from worldstate.session import cut_lineage


def hierarchy_paths(nodes: DataFrame) -> DataFrame:
    """Adds ``path`` (root first) and ``depth``; nodes not reachable from a root are left out.

    Ancestor links are doubled each round, so a tree of depth d takes about log2(d) joins.
    Nodes below a missing parent and nodes on a cycle have no root. ``uid`` must be unique.
    """
    links = nodes.select(
        "uid",
        F.nullif(F.col("parent_uid"), F.lit("")).alias("_next"),
        F.array("uid").alias("path"),
    )
    links = cut_lineage(links, "paths")
    while not links.filter(F.col("_next").isNotNull()).isEmpty():
        upper = links.select(F.col("uid").alias("_u"), F.col("_next").alias("_far"), F.col("path").alias("_above"))
        climbing = (
            links.filter(F.col("_next").isNotNull())
            .join(upper, F.col("_next") == F.col("_u"))
            .filter(~F.arrays_overlap("path", "_above"))
            .select("uid", F.col("_far").alias("_next"), F.concat("_above", "path").alias("path"))
        )
        links = cut_lineage(links.filter(F.col("_next").isNull()).unionByName(climbing), "paths")
    found = links.select("uid", "path", (F.size("path") - 1).alias("depth"))
    return nodes.join(found, "uid").select(*nodes.columns, "path", "depth")


def preorder(nodes: DataFrame) -> DataFrame:
    """Depth-first order, siblings by uid; sorts the whole table by range."""
    return hierarchy_paths(nodes).orderBy("path")


def preorder_places(nodes: DataFrame) -> DataFrame:
    """Adds ``path``, ``depth`` and ``place``, the position in depth-first order from 1."""
    return number_in_order(hierarchy_paths(nodes), ["path"])


def subtree(nodes: DataFrame, uid: str) -> DataFrame:
    """All descendants of ``uid``, with depth below it.

    Walks down one level per join; only the part of the table below ``uid`` is carried along.
    """
    fields = nodes.columns
    level = nodes.filter(F.col("parent_uid") == uid).withColumn("below", F.lit(1))
    found = level = cut_lineage(level, "subtree")
    while not level.isEmpty():
        heads = level.select(F.col("uid").alias("parent_uid"), F.col("below").alias("_b"))
        level = nodes.join(heads, "parent_uid").select(*fields, (F.col("_b") + 1).alias("below"))
        level = cut_lineage(level.join(found.select("uid"), "uid", "left_anti").select(*fields, "below"), "subtree")
        found = found.unionByName(level)
    return found


def children_of(entities: DataFrame, parents: DataFrame) -> DataFrame:
    """Entities one level below the given uids, with all fields."""
    wanted = parents.select(F.col("uid").alias("parent_uid")).distinct()
    return entities.join(wanted, "parent_uid", "left_semi").select(*entities.columns)


def orphans(nodes: DataFrame) -> DataFrame:
    """Nodes whose parent uid is set but does not exist."""
    known = nodes.select(F.col("uid").alias("parent_uid"))
    return nodes.filter(F.col("parent_uid") != "").join(known, "parent_uid", "left_anti").select(*nodes.columns)


def merged_upwards(nodes: DataFrame, merges: Mapping[str, Callable[[str], Column]]) -> DataFrame:
    """``uid`` and each column of ``merges`` merged over the node and all nodes below it, by its aggregate
    (``F.min``, ``F.max``, ``F.sum``; one whose merged values merge again).

    Each node points 2^k levels up and holds what lies less than 2^k levels below. A round gives that to the
    node it points at, merged map-side first, and doubles the pointers: about log2(depth) rounds, each with one row per node
    and no paths. Nodes below a missing parent and nodes on a cycle are left out, as in ``hierarchy_paths``.
    """
    links = nodes.select("uid", F.nullif(F.col("parent_uid"), F.lit("")).alias("_next"), *merges)
    links, ended = cut_lineage(links, "upwards"), -1
    while True:
        done, left = links.agg(F.count_if(F.col("_next").isNull()), F.count("_next")).first()
        if not left or done == ended:  # each round ends the next depths of every rooted tree; what does not end is a cycle
            return links.filter(F.col("_next").isNull()).select("uid", *merges)
        ended = done
        pointing = links.filter(F.col("_next").isNotNull())
        given = pointing.groupBy(F.col("_next").alias("uid")).agg(*[merge(c).alias(f"_{c}") for c, merge in merges.items()])
        upper = links.select(F.col("uid").alias("_u"), F.col("_next").alias("_far"))
        moved = pointing.join(upper, F.col("_next") == F.col("_u")).select("uid", F.col("_far").alias("_next"), *merges)
        both = links.filter(F.col("_next").isNull()).unionByName(moved).join(given, "uid", "left")
        merged = [_of_two(merge, c) for c, merge in merges.items()]
        links = cut_lineage(both.select("uid", "_next", *merged), "upwards")


def _of_two(merge: Callable[[str], Column], column: str) -> Column:
    """A node's own value and the one it was given, merged; nulls don't count."""
    own, given = F.col(column), F.col(f"_{column}")
    pair = {F.min: F.least(own, given), F.max: F.greatest(own, given), F.sum: own + given}[merge]
    return F.coalesce(pair, own, given).alias(column)


def node_bounds(nodes: DataFrame) -> DataFrame:
    """Bounding box of each node with everything below it, and its largest edge ``bounds_size``.

    A node's own box is a cube of edge ``size`` around (x, y, z) in world space; empty boxes are
    ignored. A node without any box has null bounds and ``bounds_size`` 0.
    """
    half = F.when(F.col("size") > 0, F.col("size") / 2)
    boxes = nodes.select(
        "uid", "parent_uid",
        *[(F.col(a) - half).alias(f"lo_{a}") for a in "xyz"],
        *[(F.col(a) + half).alias(f"hi_{a}") for a in "xyz"],
    )
    merged = merged_upwards(boxes, {f"lo_{a}": F.min for a in "xyz"} | {f"hi_{a}": F.max for a in "xyz"})
    edges = [F.col(f"hi_{a}") - F.col(f"lo_{a}") for a in "xyz"]
    return merged.withColumn("bounds_size", F.coalesce(F.greatest(*edges), F.lit(0.0)))
