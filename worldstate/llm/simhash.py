"""SimHash near-duplicates: 64-bit fingerprints linked within a few bits, found with vantage-point trees.

A tree over a bounded sample of fingerprints cuts Hamming space into shards: at each node
fingerprints within the median distance of a vantage point go left, others right. A fingerprint is
kept in one shard; as a query it also visits the later shards that its ball overlaps by the
triangle inequality. A shard searches its own tree of the same kind, pruned by the same bounds, and
compares what remains exactly. So every pair within the radius is seen in some shard.

At four of 64 bits a level of the tree sends about two thirds of its queries to both sides, so the
copies per fingerprint grow as (fingerprints / shard rows) to the power 0.75. Shards are thus as
large as one task can search; inside a shard the tree needs no copies.

Equal fingerprints are one node whatever their number. Shards give a spanning forest of their
links, never the pairs. Null and empty texts, and those without words, have fingerprint zero.
Repeated rows belong to the same component. Texts of any length are read whole.

``keep_unlike`` links by shingle sets instead (five words, Jaccard similarity 0.8). Pairs that alike lie up to 18
bits apart, and at that radius balls overlap both sides of nearly every vantage point, so a tree over all
fingerprints would compare all pairs. Shards are therefore cut by least hashes: a set has the least value of each of
eight hash functions, and two sets of similarity 0.8 share a given one with a chance of 0.8, all eight missing in 3 of
a million pairs. Each shard searches its own tree; what lies within the radius, differs in size by a quarter at most
and agrees in enough further least hashes is a candidate. A shard that is too large is cut again by a second and a
third least hash. Only narrow rows go there. Whole texts are read for candidates alone, each once for its group of
candidates, and there links are exact. A group beyond 64 MB of sets is cut in blocks of which each pair meets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worldstate.llm.graphs import Forest, connected_components
from worldstate.llm.rows import ID, rejoin, with_row_id, without
from worldstate.session import cut_lineage

WORDS = 4
RADIUS = 4
SEED = 42
SAMPLE = 32_768
SHARD_ROWS = 32_768
QUERY_ROWS = 65_536
LEAF = 192
# links by sets: words of a shingle, least similarity, bits that cover it
SET_WORDS = 5
SIMILARITY = 0.8
SET_RADIUS = 18
# least hashes: those that cut shards, those that are compared, and how many of these must agree
KEYS = 8
COMPARED = 24
AGREEING = 12
SHARD_SETS = 16_384  # most rows of a shard
KEY_LEVELS = 3
SET_BYTES = 64 << 20  # hashes of sets in a task


def _shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """Hashes of all word shingles, repeats included, in pieces."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(words, len(tokens))
    starts, ends = starts[: len(tokens) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), 1 << 15):
        pairs = zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)])
        yield np.array([digest(joined[i:j], SEED) for i, j in pairs], "<u8")


def _majority(pieces: Iterable[np.ndarray]) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for hashes in pieces:
        n += len(hashes)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Majority bits of the hashes of all word shingles, repeats included."""
    return _majority(_shingle_hashes(text, words))


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", words: int = WORDS) -> DataFrame:
    """Adds ``out``: the fingerprint's 64 bits as a signed long."""

    @F.arrow_udf("long")
    def made(column: pa.Array) -> pa.Array:
        return pa.array(np.fromiter((fingerprint(v.as_py(), words) for v in column), np.int64, len(column)))

    return docs.withColumn(out, made(F.col(text)))


class Tree:
    """Vantage-point tree over uint64 fingerprints. Inner node: (point, bound, left, right); leaf: its number or rows."""

    @staticmethod
    def cut(points: np.ndarray) -> tuple[np.uint64, int, np.ndarray] | None:
        """A vantage point, the bound that halves the points best, and which lie within it."""
        best = None
        for point in points[:: max(1, len(points) // 3)][:3]:
            distance = np.bitwise_count(points ^ point)
            below = np.cumsum(np.bincount(distance, minlength=65))
            bound = int(np.argmin(np.abs(2 * below - len(points))))
            uneven = abs(2 * int(below[bound]) - len(points))
            if below[bound] < len(points) and (best is None or uneven < best[0]):
                best = (uneven, point, bound, distance <= bound)
        return best and best[1:]

    @staticmethod
    def shards(sample: np.ndarray, most: int) -> tuple[object, int]:
        """A tree whose leaves, numbered from 0, hold at most ``most`` points of the sample each."""
        count = 0

        def grow(points):
            nonlocal count
            halves = Tree.cut(points) if len(points) > most else None
            if halves is None:
                count += 1
                return count - 1
            point, bound, near = halves
            return point, bound, grow(points[near]), grow(points[~near])

        return grow(np.unique(sample)), count

    @staticmethod
    def homes(node, points: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
        if not isinstance(node, tuple):
            out[rows] = node
            return
        near = np.bitwise_count(points[rows] ^ node[0]) <= node[1]
        Tree.homes(node[2], points, rows[near], out)
        Tree.homes(node[3], points, rows[~near], out)

    @staticmethod
    def reached(node, points: np.ndarray, rows: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """The leaves that balls around the points overlap, each with the points' rows."""
        if not len(rows):
            return
        if not isinstance(node, tuple):
            yield node, rows
            return
        distance = np.bitwise_count(points[rows] ^ node[0]).astype(np.int64)
        yield from Tree.reached(node[2], points, rows[distance - radius <= node[1]], radius)
        yield from Tree.reached(node[3], points, rows[distance + radius > node[1]], radius)


def _link_all(points: np.ndarray, mine: np.ndarray, asking: np.ndarray, radius: int, forest: Forest) -> None:
    """Links all rows ``mine`` with all rows ``asking`` within the radius, in blocks."""
    for at in range(0, len(asking), 8192):
        rows = asking[at : at + 8192]
        close = np.bitwise_count(points[mine][:, None] ^ points[rows][None, :]) <= radius
        i, j = np.nonzero(close)
        forest.link(mine[i], rows[j])


def _search(points: np.ndarray, mine: np.ndarray, asking: np.ndarray, radius: int, forest, link=_link_all) -> None:
    """Links rows ``mine`` (kept here) with one another and with rows ``asking``."""
    halves = Tree.cut(points[mine]) if len(mine) > LEAF else None
    if halves is None:
        link(points, mine, np.concatenate([mine, asking]), radius, forest)
        return
    point, bound, near = halves
    left, right = mine[near], mine[~near]
    distance = np.bitwise_count(points[asking] ^ point).astype(np.int64)
    own = np.bitwise_count(points[left] ^ point).astype(np.int64)
    _search(points, left, asking[distance - radius <= bound], radius, forest, link)
    # what lies left asks right where its ball crosses the bound; the other way round finds the same pairs
    _search(points, right, np.concatenate([left[own + radius > bound], asking[distance + radius > bound]]), radius, forest, link)


class SetForest:
    """Union of rows whose shingle sets (sorted distinct hashes) are alike."""

    def __init__(self, sets: list[np.ndarray], similarity: float):
        self.sets, self.similarity = sets, similarity
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        self.parent = list(range(len(sets)))

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def alike(self, i: int, j: int) -> bool:
        both = np.concatenate([self.sets[i], self.sets[j]])
        both.sort()
        common = int((both[1:] == both[:-1]).sum())
        return common >= self.similarity * (len(both) - common)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Compares what no earlier link has joined; most of a group's pairs are joined already."""
        for i, j in zip(a.tolist(), b.tolist()):
            ri, rj = self.root(i), self.root(j)
            if ri != rj and self.alike(i, j):
                self.parent[max(ri, rj)] = min(ri, rj)


def _sized(sizes: np.ndarray, similarity: float, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
    return (small >= similarity * large) & (i != j)


def _close(points: np.ndarray, mine: np.ndarray, asking: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within the radius, found in blocks of bounded size."""
    for first in range(0, len(mine), 1024):
        own = mine[first : first + 1024]
        for at in range(0, len(asking), 2048):
            rows = asking[at : at + 2048]
            i, j = np.nonzero(np.bitwise_count(points[own][:, None] ^ points[rows][None, :]) <= radius)
            yield own[i], rows[j]


def _link_sets(points: np.ndarray, mine: np.ndarray, asking: np.ndarray, radius: int, forest: SetForest) -> None:
    for i, j in _close(points, mine, asking, radius):
        fits = _sized(forest.sizes, forest.similarity, i, j)
        forest.link(i[fits], j[fits])


class SketchForest(Forest):
    """Union of rows that are candidates: alike in size and in enough least hashes."""

    def __init__(self, sizes: np.ndarray, sketches: np.ndarray, similarity: float):
        super().__init__(len(sizes))
        self.sizes, self.sketches, self.similarity = sizes, sketches, similarity

    def candidates(self, i: np.ndarray, j: np.ndarray) -> None:
        apart = (self.root[i] != self.root[j]) & _sized(self.sizes, self.similarity, i, j)
        i, j = i[apart], j[apart]
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            agree = (self.sketches[a] == self.sketches[b]).sum(axis=1) >= AGREEING
            self.link(a[agree], b[agree])


def _link_sketches(points: np.ndarray, mine: np.ndarray, asking: np.ndarray, radius: int, forest: SketchForest) -> None:
    for i, j in _close(points, mine, asking, radius):
        forest.candidates(i, j)


def _groups(batches: Iterable[pa.RecordBatch], keys: list[str], least: int) -> Iterator[pa.Table]:
    """Rows of sorted batches that share ``keys`` (whole numbers), of groups of at least ``least`` rows."""
    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy() for k in keys])
        starts = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1
        edges = [0, *starts.tolist(), batch.num_rows]
        if last is not None and (values[:, 0] != last).any():
            if sum(b.num_rows for b in waiting) >= least:
                yield pa.Table.from_batches(waiting)
            waiting = []
        last = values[:, -1]
        waiting.append(batch.slice(0, edges[1]))
        if len(edges) > 2:
            if sum(b.num_rows for b in waiting) >= least:
                yield pa.Table.from_batches(waiting)
            inner = np.array(edges[1:-1])
            for k in np.flatnonzero(np.diff(inner) >= least).tolist():
                yield pa.Table.from_batches([batch.slice(edges[k + 1], edges[k + 2] - edges[k + 1])])
            waiting = [batch.slice(edges[-2])]
    if waiting and sum(b.num_rows for b in waiting) >= least:
        yield pa.Table.from_batches(waiting)


def _forest_links(nodes: np.ndarray, roots: np.ndarray) -> Iterator[pa.RecordBatch]:
    own = np.flatnonzero(roots != np.arange(len(roots)))
    if len(own):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[roots[own]])], ["a", "b"])


def sketch_links(classes: DataFrame, radius: int = SET_RADIUS, similarity: float = SIMILARITY, most: int = SHARD_SETS) -> DataFrame:
    """``a, b``: links that connect at least the sets of ``similarity`` (and more).

    ``classes`` has distinct ``node`` (long), ``fingerprint``, ``size``, ``keys`` (least hashes, longs) and ``sketch``
    (bytes). Shards above ``most`` rows are cut by further least hashes; what shares ``KEY_LEVELS`` of them in such
    numbers is cut into blocks of which each pair meets.
    """
    fields = ["node", "fingerprint", "size", "sketch"]
    level = classes.select(*fields, "keys", F.posexplode("keys").alias("t", "v"))
    level = level.select(*fields, "keys", F.xxhash64("t", "v").alias("shard"), F.array("t").alias("used"))
    ready = []
    for depth in range(1, KEY_LEVELS + 1):
        hot = cut_lineage(level.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most), "hot")
        if hot.isEmpty():
            ready.append(level.select(*fields, "shard"))
            break
        ready.append(level.join(hot, "shard", "left_anti").select(*fields, "shard"))
        crowded = level.join(hot, "shard")
        if depth < KEY_LEVELS:
            crowded = crowded.select(*fields, "keys", "shard", "used", F.posexplode("keys").alias("t", "v"))
            # in one order only: the same keys in another order would be the same shard again
            crowded = crowded.filter(F.col("t") > F.element_at("used", -1))
            level = crowded.select(*fields, "keys", F.xxhash64("shard", "t", "v").alias("shard"), F.concat("used", F.array("t")).alias("used"))
        else:
            blocks = F.ceil(F.col("n") * 2 / most).cast("int")
            crowded = crowded.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
            cells = crowded.select(*fields, "shard", "block", other)
            ready.append(cells.select(*fields, F.xxhash64("shard", F.least("block", "other"), F.greatest("block", "other")).alias("shard")))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ["shard"], 2):
            rows = np.arange(table.num_rows)
            sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(rows), -1)
            forest = SketchForest(table["size"].to_numpy(), sketches, similarity)
            _search(table["fingerprint"].to_numpy().view(np.uint64), rows, rows[:0], radius, forest, _link_sketches)
            yield from _forest_links(table["node"].to_numpy(), forest.root)

    dealt = reduce(DataFrame.unionByName, ready).repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(linked, "a long, b long")


def set_links(members: DataFrame, words: int, radius: int = SET_RADIUS, similarity: float = SIMILARITY, most_bytes: int = SET_BYTES) -> DataFrame:
    """``a, b``: links that connect just what all pairs of ``similarity`` (within ``radius`` bits) of a group connect.

    ``members`` has ``root`` (the group, long), ``node``, ``fingerprint``, ``size`` and ``text``.
    """
    sums = members.groupBy("root").agg(F.sum(8 * F.col("size").cast("long")).alias("bytes"))
    cut = cut_lineage(sums.filter(F.col("bytes") > most_bytes).select("root", F.ceil(F.col("bytes") * 2 / most_bytes).cast("int").alias("blocks")), "large")
    placed = members.join(cut, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = placed.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other"))
    placed = placed.select(cell.alias("cell"), "node", "fingerprint", "text")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ["cell"], 2):
            rows = np.arange(table.num_rows)
            forest = SetForest([_shingle_set(v.as_py(), words) for v in table["text"]], similarity)
            _search(table["fingerprint"].to_numpy().view(np.uint64), rows, rows[:0], radius, forest, _link_sets)
            yield from _forest_links(table["node"].to_numpy(), np.array([forest.root(i) for i in rows.tolist()]))

    return placed.repartition("cell").sortWithinPartitions("cell").mapInArrow(linked, "a long, b long").filter("a <> b")


def near_links(fingerprints: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``a, b``: links that connect just what all pairs within ``radius`` bits connect.

    ``fingerprints`` has distinct longs in ``fingerprint``. The sample has 32,768 at most, taken by
    hash; its tree, and the counts of the shards, are all that passes through the driver.
    """
    total = fingerprints.count()
    sample = fingerprints.orderBy(F.xxhash64("fingerprint")).limit(SAMPLE).toArrow()["fingerprint"].to_numpy()
    tree, shards = Tree.shards(sample.view(np.uint64), max(4, len(sample) * shard_rows // max(total, 1)))

    def visits(points: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[int, np.ndarray]]]:
        home = np.empty(len(points), np.int64)
        rows = np.arange(len(points))
        Tree.homes(tree, points, rows, home)
        return home, ((leaf, r[home[r] < leaf]) for leaf, r in Tree.reached(tree, points, rows, radius))

    def counted(batches):
        asking = np.zeros(shards, np.int64)
        for batch in batches:
            for leaf, rows in visits(batch.column(0).to_numpy().view(np.uint64))[1]:
                asking[leaf] += len(rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shards)), pa.array(asking)], ["leaf", "n"])

    load = fingerprints.select("fingerprint").mapInArrow(counted, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n"))
    blocks = np.ones(shards, np.int64)
    for leaf, n in load.collect():
        blocks[leaf] = max(1, -(-n // QUERY_ROWS))

    def routed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                values = batch.column(0).slice(at, 2048).to_numpy()
                points = values.view(np.uint64)
                home, found = visits(points)
                copies = np.repeat(np.arange(len(points)), blocks[home])
                first = np.cumsum(blocks[home]) - blocks[home]
                leaves, rows, block = [home[copies]], [copies], [np.arange(len(copies)) - np.repeat(first, blocks[home])]
                kept = [np.ones(len(copies), bool)]
                for leaf, own in found:
                    leaves.append(np.full(len(own), leaf))
                    rows.append(own)
                    block.append((points[own] % np.uint64(blocks[leaf])).astype(np.int64))
                    kept.append(np.zeros(len(own), bool))
                columns = [np.concatenate(leaves), np.concatenate(block), values[np.concatenate(rows)], np.concatenate(kept)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["leaf", "block", "fingerprint", "home"])

    def linked(table: pa.Table) -> pa.Table:
        values = table["fingerprint"].to_numpy()
        home = table["home"].to_numpy()
        forest = Forest(len(values))
        _search(values.view(np.uint64), np.flatnonzero(home), np.flatnonzero(~home), radius, forest)
        a, b = forest.edges()
        return pa.table({"a": values[a], "b": values[b]})

    visits_table = fingerprints.select("fingerprint").mapInArrow(routed, "leaf long, block long, fingerprint long, home boolean")
    return visits_table.groupBy("leaf", "block").applyInArrow(linked, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """``key, fingerprint (16 hex digits), component_id``: the least key reachable by links, the row's own included.

    A null key takes part in links but names no component, unless it is alone.
    """
    marked = cut_lineage(with_fingerprints(docs.select(F.col(key), F.col(text)), text, "fingerprint", words).select(key, "fingerprint"), "fingerprints")
    classes = cut_lineage(marked.groupBy("fingerprint").agg(F.min(key).alias("least")), "classes")
    roots = connected_components(near_links(classes, radius))
    rooted = classes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "fingerprint"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    owned = rooted.select("fingerprint", "root").join(named, "root").select("fingerprint", "component_id")
    return marked.join(owned, "fingerprint").select(key, F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


_FACTORS = np.random.default_rng(SEED).integers(1 << 62, 1 << 63, KEYS + COMPARED, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = np.random.default_rng(SEED + 1).integers(0, 1 << 63, KEYS + COMPARED, np.uint64)


def _shingle_set(text: str | None, words: int) -> np.ndarray:
    pieces = list(_shingle_hashes(text, words))
    return np.unique(np.concatenate(pieces)) if pieces else np.zeros(0, np.uint64)


def with_sketches(docs: DataFrame, text: str, words: int = SET_WORDS) -> DataFrame:
    """Adds ``__set``: fingerprint, node (a digest of the shingle set), size, keys and sketch (least hashes; empty sets have none)."""

    @F.arrow_udf("fingerprint long, node long, size int, keys array<long>, sketch binary")
    def made(column: pa.Array) -> pa.Array:
        found: list[list] = [[], [], [], [], []]
        for value in column:
            pieces = list(_shingle_hashes(value.as_py(), words))
            whole = np.unique(np.concatenate(pieces)) if pieces else np.zeros(0, np.uint64)
            least = np.full(KEYS + COMPARED, ~np.uint64(0))
            for at in range(0, len(whole), 4096):
                mixed = whole[at : at + 4096, None] * _FACTORS + _SHIFTS
                least = np.minimum(least, (mixed ^ mixed >> np.uint64(31)).min(axis=0))
            row = (_majority(pieces), int(np.uint64(xxhash.xxh64_intdigest(whole.tobytes(), SEED)).astype(np.int64)), len(whole))
            row = (*row, least[:KEYS].view(np.int64).tolist() if pieces else [], least[KEYS:].astype(np.uint8).tobytes())
            for own, field in zip(found, row):
                own.append(field)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(found, kinds)], ["fingerprint", "node", "size", "keys", "sketch"])

    return docs.withColumn("__set", made(F.col(text)))


def keep_unlike(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SET_WORDS, similarity: float = SIMILARITY, radius: int = SET_RADIUS
) -> DataFrame:
    """One row of each component of texts whose shingle sets have ``similarity``: the least key that is not null.

    Texts with the same set are one node; of their fingerprints, which repeats may change, the least is taken.
    """
    marked = with_row_id(docs).select(F.col(key).alias("key"), *ID, F.col(text).alias("text"))
    marked = cut_lineage(with_sketches(marked, "text", words).select("key", *ID, "__set.*"), "sketches")
    row = F.struct(F.col("key").isNull().alias("none"), "key", *ID).alias("row")
    marked = marked.select("node", row, "fingerprint", "size", "keys", "sketch")
    same = [F.min(F.struct("row", "keys", "sketch")).alias("least"), F.min("fingerprint").alias("fingerprint"), F.first("size").alias("size")]
    classes = marked.groupBy("node").agg(*same)
    classes = cut_lineage(classes.select("node", "fingerprint", "size", "least.*"), "classes")
    groups = connected_components(sketch_links(classes, radius, similarity))
    members = groups.join(classes.select("node", "fingerprint", "size", "row"), "node")
    rows = cut_lineage(marked.select("row.*").groupBy(*ID).agg(F.count(F.lit(1)).alias("__rows")), "rows")
    members = members.select("root", "node", "fingerprint", "size", *[F.col(f"row.{c}").alias(c) for c in ID]).join(rows, list(ID))
    texts = rejoin(docs, cut_lineage(members, "members"), {"text": F.col(text)}, few=True)
    roots = connected_components(set_links(texts, words, radius, similarity))
    rooted = classes.join(roots, "node", "left")
    kept = rooted.groupBy(F.coalesce("root", "node")).agg(F.min("row").alias("row")).select("row.*").select(*ID)
    kept = cut_lineage(kept, "kept")
    dropped = cut_lineage(rows.join(kept, list(ID), "left_anti"), "dropped")
    repeated = rows.filter("__rows > 1").join(kept, list(ID), "left_semi")
    return without(docs, dropped, repeated).select(*[F.col(f"`{c}`") for c in docs.columns])
