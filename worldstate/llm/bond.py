"""Hard negatives by a vertical scan that shrinks a candidate bitmap dimension by dimension (BOND).

Components count as whole numbers ``floor(scale * x)`` and nearness is their inner product, exactly. Rows are
dealt by hash into shards; a shard is one task, which keeps its candidates as columns, one per dimension, with
the least and largest value of each. Anchors stream past the shard. For an anchor the columns are read in the
order of its largest magnitudes, a few at a time; what the columns still unread can add lies between the sums of
their least and largest contributions. Candidates whose bounds cannot reach the answer leave the bitmap, until
only rows remain whose scores are exact. First the nearest rows of the same label (positives) are found, then for
each positive the nearest rows of other labels inside its window of scores.

A shard holds ``SHARD_VALUES`` components at most, whatever the labels, so a hot label or a vector with many
copies is spread like any other; each row is sent to one shard and each anchor to every shard.

Rows with a null key, label or vector, or with a null or non-finite component take no part. Vectors shorter than
the longest one count as ending in zeros. Rows that repeat a key are rows of their own; an anchor's positives bear
other keys than its own, and an anchor that stands twice is answered twice. Ties go to the smaller key. A score
beyond 64 bits counts as the nearest number of 64 bits. Other columns are ignored, whatever their names. An empty
table, and anchors without positives or negatives, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worldstate.llm.vectors import complete
from worldstate.session import cut_lineage

POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90
SCALE = 256
SHARD_VALUES = 1 << 22
LEAST_ROWS = 4096
STEP = 8
EXACT = 2.0**53
LARGEST = (1 << 63) - 1


def _padded(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """Whole numbers, as doubles, of a list column; one row per list."""
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths == width).all():
        return values.reshape(len(column), width)
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = values
    return out


class Shard:
    """Candidates of one task as columns, rows of one label next to one another."""

    def __init__(self, table: pa.Table, width: int, scale: int):
        table = table.combine_chunks()
        codes = {label: k for k, label in enumerate(table["label"].unique().to_pylist())}
        own = np.fromiter((codes[v] for v in table["label"].to_pylist()), np.int64, table.num_rows)
        order = np.argsort(own, kind="stable")
        self.codes, self.edges = codes, np.searchsorted(own[order], np.arange(len(codes) + 1))
        self.keys = table["key"].to_numpy()[order]
        vectors = table["vector"].combine_chunks() if isinstance(table["vector"], pa.ChunkedArray) else table["vector"]
        self.columns = np.ascontiguousarray(_padded(vectors, width, scale)[order].T)
        self.low, self.high = (f(self.columns, axis=1, initial=0.0) for f in (np.min, np.max))
        self.most = max(abs(self.low).max(initial=0.0), abs(self.high).max(initial=0.0))

    def rows(self, label, same: bool) -> np.ndarray:
        code = self.codes.get(label)
        first, last = (0, 0) if code is None else self.edges[code : code + 2]
        if same:
            return np.arange(first, last)
        return np.concatenate([np.arange(first), np.arange(last, len(self.keys))])

    def scores(self, anchor: np.ndarray, rows: np.ndarray, needed) -> tuple[np.ndarray, np.ndarray]:
        """Rows that ``needed(lower, upper)`` keeps to the end, and their exact scores."""
        if self.most * abs(anchor).max(initial=0.0) * max(len(anchor), 1) >= EXACT:  # whole numbers of any size
            large = [int(v) for v in anchor]
            exact = [sum(int(c) * a for c, a in zip(self.columns[:, r], large)) for r in rows]
            found = np.array([min(max(s, -LARGEST), LARGEST) for s in exact], object)
            return rows, found
        order = np.argsort(-abs(anchor), kind="stable")
        ends = np.stack([anchor * self.low, anchor * self.high])[:, order]
        least, most = (np.append(np.cumsum(e[::-1])[::-1], 0.0) for e in (ends.min(axis=0), ends.max(axis=0)))
        partial = np.zeros(len(rows))
        for at in range(0, len(order), STEP):
            dims, left = order[at : at + STEP], min(at + STEP, len(order))
            partial += anchor[dims] @ self.columns[dims[:, None], rows[None, :]]
            alive = needed(partial + least[left], partial + most[left])
            if not alive.all():
                rows, partial = rows[alive], partial[alive]
            if not len(rows):
                break
        return rows, partial

    def first(self, rows: np.ndarray, scores: np.ndarray, most: int) -> list[tuple[int, int]]:
        """``(score, key)`` of the first ``most`` rows, larger scores first, then smaller keys."""
        if scores.dtype == object:
            return sorted(((s, k) for s, k in zip(scores.tolist(), self.keys[rows].tolist())), key=lambda p: (-p[0], p[1]))[:most]
        order = np.lexsort((self.keys[rows], -scores))[:most]
        return list(zip(scores[order].astype(np.int64).tolist(), self.keys[rows[order]].tolist()))


def _at_least(values: np.ndarray, most: int) -> float:
    return np.partition(values, len(values) - most)[len(values) - most] if len(values) > most else -np.inf


def nearest(shard: Shard, anchor: np.ndarray, key: int, label, most: int) -> list[tuple[int, int]]:
    """The first rows of the anchor's label with another key."""
    rows = shard.rows(label, True)
    rows = rows[shard.keys[rows] != key]
    return shard.first(*shard.scores(anchor, rows, lambda lower, upper: upper >= _at_least(lower, most)), most)


def in_windows(shard: Shard, anchor: np.ndarray, label, windows: list[tuple[int, int]], most: int) -> list[list[tuple[int, int]]]:
    """For each window of scores (both ends included) the first rows of other labels inside it."""

    def needed(lower, upper):
        kept = np.zeros(len(lower), bool)
        for low, high in windows:
            inside = (upper >= low) & (lower <= high)
            sure = lower[(lower >= low) & (upper <= high)]
            kept |= inside & (upper >= _at_least(sure, most)) if len(sure) >= most else inside
        return kept

    rows, scores = shard.scores(anchor, shard.rows(label, False), needed)
    found = []
    for low, high in windows:
        inside = np.array([low <= s <= high for s in scores.tolist()], bool)
        found.append(shard.first(rows[inside], scores[inside], most))
    return found


def _streamed(batches: Iterator[pa.RecordBatch], width: int, scale: int) -> Iterator[tuple[Shard, pa.RecordBatch]]:
    """Each batch of anchors with the shard it meets; a shard's candidates come before its anchors."""
    waiting, shard, at = [], None, None
    for batch in batches:
        marks = batch.column("shard").to_numpy() * 2 + batch.column("asks").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(marks)) + 1
        for first, last in zip([0, *cuts], [*cuts, len(marks)]):
            part, mark = batch.slice(first, last - first), marks[first] if last > first else None
            if mark is None:
                continue
            if mark // 2 != at:
                waiting, shard, at = [], None, mark // 2
            if mark % 2 == 0:
                waiting.append(part.select(["key", "label", "vector"]))
                continue
            if shard is None and waiting:
                shard, waiting = Shard(pa.Table.from_batches(waiting), width, scale), []
            if shard is not None:
                yield shard, part


def _meet(rows: DataFrame, anchors: DataFrame, shards: int) -> DataFrame:
    """One partition per shard: its candidates first, then all anchors."""
    own = F.pmod(F.xxhash64("key", "row"), F.lit(shards)).cast("int")
    extra = [c for c in anchors.columns if c not in rows.columns]
    nothing = [F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in extra]
    candidates = rows.select("*", *nothing, own.alias("shard"), F.lit(False).alias("asks"))
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    asking = anchors.select(*rows.columns, *extra, every, F.lit(True).alias("asks"))
    return candidates.unionByName(asking).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "asks")


def hard_negatives(
    table: DataFrame, is_anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, shard_values: int = SHARD_VALUES,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` (keys are longs).

    ``is_anchor`` is a condition on the columns of ``table``. For each anchor and each of its first ``positives``
    rows of the same label: the first ``negatives`` rows of other labels whose score lies between ``low`` and
    ``high`` hundredths of the positive's.
    """
    usable = table.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & F.coalesce(complete(F.col(vector)), F.lit(False)))
    rows = usable.select(F.col(key).cast("long").alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    total, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    cores = table.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-total * max(width, 1) // shard_values), min(cores, -(-total // LEAST_ROWS)))
    anchors = rows.filter("anchor").select("row", "key", "label", "vector")
    rows = rows.select("row", "key", "label", "vector")

    def near(batches):
        for shard, asking in _streamed(batches, width, scale):
            found = []
            asked = zip(*(asking.column(c).to_pylist() for c in ("row", "key", "label")), _padded(asking.column("vector"), width, scale))
            for row, own, name, anchor in asked:
                found += [(row, score, other) for score, other in nearest(shard, anchor, own, name, positives)]
            yield _batch(found, ["row", "positive_score", "positive_id"])

    found = _meet(rows, anchors, shards).mapInArrow(near, "row long, positive_score long, positive_id long")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id"))
    first = found.withColumn("place", place).filter(F.col("place") <= positives)
    windows = F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("windows")
    first = first.filter("positive_score >= 0").groupBy("row").agg(windows)
    asking = cut_lineage(anchors.join(first, "row"), "positives")

    def hard(batches):
        for shard, asking in _streamed(batches, width, scale):
            found = []
            asked = zip(*(asking.column(c).to_pylist() for c in ("row", "label", "windows")), _padded(asking.column("vector"), width, scale))
            for row, name, wanted, anchor in asked:
                limits = [(-(-low * w["positive_score"] // 100), high * w["positive_score"] // 100) for w in wanted]
                for w, hits in zip(wanted, in_windows(shard, anchor, name, limits, negatives)):
                    found += [(row, w["place"], score, other) for score, other in hits]
            yield _batch(found, ["row", "place", "negative_score", "negative_id"])

    found = _meet(rows, asking, shards).mapInArrow(hard, "row long, place long, negative_score long, negative_id long")
    rank = F.row_number().over(Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id"))
    found = found.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    known = asking.select("row", F.col("key").alias("anchor_id"), F.explode("windows").alias("w"))
    known = known.select("row", "anchor_id", F.col("w.place").cast("long").alias("place"), "w.positive_id", "w.positive_score")
    return found.join(known, ["row", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _batch(found: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = zip(*found) if found else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def negative_report(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh one bears the next label."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(embeddings.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


NEGATIVE_SQL = f"""
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor({SCALE} * cast(x as double))) as q
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, a.label = b.label as alike, b.vec_id as other_id, cast(list_inner_product(a.q, b.q) as bigint) as score
  from rows a join rows b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
positives as (
  select anchor_id, other_id as positive_id, score as positive_score from scored where alike
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= {POSITIVES})
select p.anchor_id, p.positive_id,
  cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id) as int) as rank,
  s.other_id as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s on s.anchor_id = p.anchor_id and not s.alike
  and {LOW} * p.positive_score <= 100 * s.score and 100 * s.score <= {HIGH} * p.positive_score
qualify rank <= {NEGATIVES}
"""
