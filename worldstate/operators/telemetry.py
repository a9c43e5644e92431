"""Counts and telemetry: server metrics, value counts, groups, inventories, counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worldstate.functions.vectors import vec, vec_distance
from worldstate.operators.ordered import ROWS_PER_TASK, Ordered

# fixed values: prop types with a metric of their own
PROP_TYPES = ("box50cm", "box4m", "ship")
# fixed values: measures a server reports
MEASURES = ("memory", "numberobjects", "timefps", "currentplayers")


def server_metrics(players: DataFrame, props: DataFrame, prop_type: str = "prop_type") -> DataFrame:
    """One row per server: ``currentplayers`` and ``current<type>`` for each prop type."""
    online = players.groupBy("server_id").agg(F.count(F.lit(1)).alias("currentplayers"))
    owned = props.groupBy("server_id").pivot(prop_type, list(PROP_TYPES)).agg(F.count(F.lit(1)))
    both = online.join(owned, "server_id", "full")
    counts = {"currentplayers": "currentplayers"} | {t: f"current{t}" for t in PROP_TYPES}
    return both.select("server_id", *[F.coalesce(F.col(c), F.lit(0)).alias(n) for c, n in counts.items()])


def metrics_windows(samples: DataFrame, width: str = "1 minute", at: str = "ts") -> DataFrame:
    """Tumbling windows per server: mean and maximum of each measure. Works on streams too."""
    aggs = [agg(m).alias(f"{label}_{m}") for m in MEASURES for label, agg in (("avg", F.avg), ("max", F.max))]
    spans = samples.groupBy("server_id", F.window(at, width).alias("w")).agg(F.count(F.lit(1)).alias("samples"), *aggs)
    return spans.select("server_id", F.col("w.start").alias("window_start"), *[c for c in spans.columns if c not in ("server_id", "w")])


def planet_height_range(vertices: DataFrame, planet: str = "planet", centre=(0.0, 0.0, 0.0)) -> DataFrame:
    """Smallest and largest distance from the centre per planet."""
    height = vec_distance(vec(), tuple(F.lit(c) for c in centre))
    return vertices.groupBy(planet).agg(F.min(height).alias("min_height"), F.max(height).alias("max_height"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count per value, with the number of values, the sum and the maximum of all counts."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(
        F.struct(F.count(F.lit(1)).alias("unique"), F.sum("n").alias("sum"), F.max("n").alias("max")).alias("w")
    ).scalar()
    return counts.select("value", "n", whole["unique"].alias("unique_values"), whole["sum"].alias("sum_n"), whole["max"].alias("max_n"))


def group_members(df: DataFrame, one: str, many: str) -> DataFrame:
    """Distinct members of each group, one row per member, so groups may be of any size."""
    return df.select(one, many).distinct()


def group_sizes(df: DataFrame, one: str, many: str) -> DataFrame:
    return group_members(df, one, many).groupBy(one).agg(F.count(F.lit(1)).alias("members"))


def universe_inventory(df: DataFrame, kind: str = "type_obj") -> DataFrame:
    """Objects per kind, and the total in the row ``kind = 'all'``."""
    counted = df.groupBy(F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    rolled = counted.rollup("kind").agg(F.sum("n").alias("objects"), F.grouping("kind").alias("_g"))
    return rolled.select(F.when(F.col("_g") == 1, "all").otherwise(F.col("kind")).alias("kind"), "objects")


def counter_since(
    df: DataFrame,
    order: Sequence[str],
    counter: str,
    is_marker: str = "is_marker",
    keys: Sequence[str] = ("marker",),
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Adds ``since``: change of the counter since the latest marker row of its key; -1 without one."""
    marked = F.when(F.col(is_marker), F.col(counter))
    rows = Ordered(df, keys, order, rows_per_task).last_known("_at", marked).result()
    return rows.withColumn("since", F.coalesce(F.col(counter) - F.col("_at"), F.lit(-1))).drop("_at")


def translation_coverage(long: DataFrame) -> DataFrame:
    """Per locale: texts present and missing, and the share present. Input: key, locale, text."""
    present = F.count_if(F.col("text").isNotNull())
    return long.groupBy("locale").agg(
        present.alias("present"),
        F.count_if(F.col("text").isNull()).alias("missing"),
        (present / F.count(F.lit(1))).alias("ratio"),
    )
