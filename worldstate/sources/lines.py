"""Text files as numbered lines, read in parallel blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str, one_text: bool = False) -> DataFrame:
    """``file, line_no, value`` of every line, in file order from 0.

    Files are read in splits, never whole. Lines of a split are numbered in reading order; the
    number of lines before each split is a prefix sum over splits (one small row per split).
    With ``one_text`` the files of a folder continue one another in name order, as the parts
    written by one sorted Spark job do; ``file`` is then the folder.
    """
    read = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    blocks = read.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    text = F.regexp_replace("file", "/[^/]*$", "") if one_text else F.col("file")
    before = Window.partitionBy("_text").orderBy("file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("_text", text).select(
        "file", "_block", "_text", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    return read.join(starts, ["file", "_block"]).select(
        F.col("_text").alias("file"), (F.col("_id") + F.col("_shift")).alias("line_no"), "value"
    )
