"""Shards of near equal bytes by longest-processing-time scheduling of groups.

Groups (equal texts) must stay together. They are taken largest first, each to the shard with the
least bytes so far, found by a heap. Only a histogram of group sizes is scheduled on the driver:
sizes to 11 leading bits (below 2048 exact), so at most 1024 per power of two, however many groups
there are. Within one size the groups are alike to 1 in 1024 and are dealt by their number.
Many groups of one size are poured in at once up to the level they would reach, then go by heap.

Null text is like empty text (16 bytes per row, checksum 0). A group larger than a fair share
fills a shard of its own; groups are never cut. Repeated rows are rows of the same group.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worldstate.llm.numbering import digest_of, number_rows
from worldstate.session import cut_lineage

SHARDS = 40
ROW_BYTES = 16
LEADING_BITS = 11


def size_class(size: Column) -> Column:
    """The size with all but its 11 leading bits set to zero."""
    drop = F.greatest(F.lit(0), F.length(F.bin(size)) - LEADING_BITS).cast("int")
    unit = F.pow(F.lit(2.0), drop).cast("long")
    return F.floor(size / unit) * unit


def _pour(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` items of ``size`` each load gets if each in turn goes to the least load."""
    shards = len(loads)
    got = [0] * shards
    if count > 2 * shards:
        rest, level, below = (count - shards) * size, 0, 0
        for below, load in enumerate(sorted(loads)):
            if (load - level) * below > rest:
                below -= 1
                break
            rest -= (load - level) * below
            level = load
        level += rest // (below + 1)
        got = [max(0, (level - load) // size) for load in loads]
    heap = [(load + n * size, i) for i, (load, n) in enumerate(zip(loads, got))]
    heapq.heapify(heap)
    for _ in range(count - sum(got)):
        load, i = heap[0]
        heapq.heapreplace(heap, (load + size, i))
        got[i] += 1
    return got


def longest_first(histogram: list[tuple[int, int, int]], shards: int) -> list[tuple[int, list[int], list[int]]]:
    """For each ``(class, groups, bytes)``: the class, the shards it goes to, and the number of its
    groups dealt up to and with each of them."""
    loads, plan = [0] * shards, []
    for size, count, total in sorted(histogram, reverse=True):
        mean = max(1, total // count)
        got = _pour(loads, mean, count)
        used = [i for i in sorted(range(shards), key=lambda i: (loads[i], i)) if got[i]]
        ends, end = [], 0
        for i in used:
            end += got[i]
            ends.append(end)
            loads[i] += got[i] * mean
        plan.append((size, used, ends))
    return plan


def assign_shards(docs: DataFrame, group: Column, size: Column, shards: int = SHARDS) -> DataFrame:
    """Adds ``shard``. ``group`` is a hex digest; rows alike in it stay together."""
    rows = docs.withColumns({"__group": group, "__size": size})
    groups = cut_lineage(rows.groupBy("__group").agg(F.sum("__size").alias("__bytes")).withColumn("__class", size_class(F.col("__bytes"))), "groups")
    counted = groups.groupBy("__class").agg(F.count(F.lit(1)).alias("n"), F.sum("__bytes").alias("bytes"))
    plan = longest_first([tuple(r) for r in counted.collect()], shards)
    plan_table = docs.sparkSession.createDataFrame(plan, "__class long, __used array<int>, __ends array<long>")
    keyed = plan_table.select(F.col("__class").cast("string").alias("__key"), "__used", "__ends")
    numbered = number_rows(groups, F.col("__class").cast("string"), F.col("__group"), "__n", extra=keyed)
    at = F.size(F.filter("__ends", lambda end: end <= F.col("__n")))
    placed = numbered.select("__group", F.get("__used", at).alias("shard"))
    return rows.drop("shard").join(placed, "__group").drop("__group", "__size")


def shard_report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: its size, checksum, shard and gapless slot within the shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        digest_of(text).alias("digest"),
    )
    placed = assign_shards(rows, F.col("digest"), F.col("size"), shards)
    numbered = number_rows(placed, F.col("shard").cast("string"), digest_of(F.col("doc_id")), "slot", (F.col("doc_id"), F.col("text_crc32")))
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
