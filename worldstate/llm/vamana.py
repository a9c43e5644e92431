"""Approximate nearest neighbours by inner product over sharded, robustly pruned graphs.

Distinct vectors are dealt to shards by hash. In a shard a directed graph is built: a greedy search
from the start node proposes neighbours for each vector, and robust pruning keeps a neighbour
only if no kept one is nearer to it by the factor ``ALPHA``, so edges point in diverse directions.
Every shard is searched for every query by beam search, and the best of all shards are kept.

Inner product becomes Euclidean distance by one more component, the square root of the largest
squared norm in the shard less the vector's own, so vectors need not be normalised. Scores
are inner products of the original vectors in double precision.

Equal vectors are one node; the smallest ids of each (as many as can be asked for) stand behind
it, so ties go to smaller ids and a vector with many copies is no hot spot. Vectors that are
null, empty, zero, or hold null or non-finite components take no part, neither do rows with
null ids; vectors of different lengths are different spaces. Repeated rows of one id count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worldstate.llm.vectors import matrix, usable, vector_digest
from worldstate.session import cut_lineage

SHARD_ROWS = 8192
QUERY_ROWS = 4096
DEGREE = 32
BUILD_BEAM = 64
SEARCH_BEAM = 128
RANDOM = 8
ALPHA = 1.2
BATCH = 256


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors whose Euclidean order from any lifted query is the order of inner products."""
    squares = np.einsum("ij,ij->i", vectors, vectors)
    return np.hstack([vectors, np.sqrt(np.maximum(squares.max() - squares, 0))[:, None]])


def beam_search(points: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest nodes met per query (-1 where fewer), nearest first, with squared distances.

    All queries take a step at a time: each expands its nearest node that isn't expanded yet.
    """
    count, squares = len(queries), np.einsum("ij,ij->i", points, points)
    own = np.einsum("ij,ij->i", queries, queries)
    nodes = np.full((count, width), -1)
    far = np.full((count, width), np.inf)
    done = np.ones((count, width), bool)
    nodes[:, 0], done[:, 0] = start, False
    far[:, 0] = own + squares[start] - 2 * queries @ points[start]
    met = np.zeros((count, len(points) + 1), bool)
    met[:, start] = met[:, -1] = True
    while True:
        open_rows = np.flatnonzero(~done.all(axis=1))
        if not len(open_rows):
            return nodes, far
        at = np.argmax(~done[open_rows], axis=1)
        done[open_rows, at] = True
        next_ = edges[nodes[open_rows, at]]
        fresh = ~met[open_rows[:, None], next_]
        met[open_rows[:, None], next_] = True
        away = own[open_rows, None] + squares[next_] - 2 * np.einsum("ijk,ik->ij", points[next_], queries[open_rows])
        nodes_ = np.hstack([nodes[open_rows], np.where(fresh, next_, -1)])
        far_ = np.hstack([far[open_rows], np.where(fresh, away, np.inf)])
        done_ = np.hstack([done[open_rows], ~fresh])
        order = np.argsort(far_, axis=1, kind="stable")[:, :width]
        nodes[open_rows] = np.take_along_axis(nodes_, order, 1)
        far[open_rows] = np.take_along_axis(far_, order, 1)
        done[open_rows] = np.take_along_axis(done_, order, 1)


def robust_prune(points: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` of the candidates (-1: none) per node, nearest first; those that a kept
    one is nearer to by ``alpha`` are left out."""
    own = points[nodes]
    away = ((points[candidates] - own[:, None]) ** 2).sum(axis=2)
    away[(candidates < 0) | (candidates == nodes[:, None])] = np.inf
    order = np.argsort(away, axis=1, kind="stable")
    candidates, away = np.take_along_axis(candidates, order, 1), np.take_along_axis(away, order, 1)
    away[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = np.inf
    kept = np.full((len(nodes), degree), -1)
    rows, squares = np.arange(len(nodes)), np.einsum("ij,ij->i", points, points)
    spots = points[candidates]
    for slot in range(degree):
        best = np.argmin(away, axis=1)
        alive = np.isfinite(away[rows, best])
        if not alive.any():
            break
        chosen = candidates[rows, best]
        kept[alive, slot] = chosen[alive]
        between = squares[candidates] + squares[chosen][:, None] - 2 * np.einsum("ijk,ik->ij", spots, points[chosen])
        away[alpha**2 * between <= away] = np.inf
        away[rows, best] = np.inf
    return kept


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Out-edges (-1: none) of every node, and the node that searches start from.

    All nodes are linked twice; the second time each meets the whole graph. Besides what its
    search proposes, a node looks at its edges so far and at some random nodes, which gives it far
    edges and lets no node go unreached.
    """
    count = len(points)
    start = int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1)))
    edges, rng = np.full((count, degree), -1), np.random.default_rng(count)
    for first_time in (True, False):
        order = rng.permutation(count)
        order = np.concatenate([[start], order[order != start]])
        at = int(first_time)
        while at < count:
            # first batches grow with the graph, so early nodes meet a graph that is nearly up to date
            nodes = order[at : at + min(BATCH, max(1, at) if first_time else BATCH)]
            known = order[:at] if first_time else order
            at += len(nodes)
            found, _ = beam_search(points, edges, start, points[nodes], beam)
            far = known[rng.integers(0, len(known), (len(nodes), RANDOM))]
            edges[nodes] = robust_prune(points, nodes, np.hstack([found, edges[nodes], far]), degree, alpha)
            _link_back(points, edges, nodes, alpha)
    return edges, start


def _link_back(points: np.ndarray, edges: np.ndarray, nodes: np.ndarray, alpha: float) -> None:
    """Gives the targets of the nodes' edges an edge back; targets with too many are pruned."""
    degree = edges.shape[1]
    rows, slots = np.nonzero(edges[nodes] >= 0)
    source, target = nodes[rows], edges[nodes[rows], slots]
    by = np.argsort(target, kind="stable")
    source, target = source[by], target[by]
    targets, first, sizes = np.unique(target, return_index=True, return_counts=True)
    for most in range(0, int(sizes.max(initial=0)), degree):  # a degree's worth at a time
        some = sizes > most
        own, begin, left = targets[some], first[some] + most, np.minimum(sizes[some] - most, degree)
        back = np.full((len(own), degree), -1)
        inside = np.arange(degree)[None, :] < left[:, None]
        back[inside] = source[(begin[:, None] + np.arange(degree)[None, :])[inside]]
        back[(back[:, :, None] == edges[own][:, None, :]).any(axis=2)] = -1
        together = np.hstack([edges[own], back])
        fits = (together >= 0).sum(axis=1) <= degree
        edges[own[fits]] = np.sort(together[fits], axis=1)[:, ::-1][:, :degree]
        if not fits.all():
            edges[own[~fits]] = robust_prune(points, own[~fits], together[~fits], degree, alpha)


def _classes(vectors: DataFrame, key: Column, vector: Column, ids: int) -> DataFrame:
    """``node, vector, members``: distinct vectors, each with its ``ids`` smallest ids."""
    fit = vectors.select(key.alias("id"), vector.alias("vector")).filter(usable(F.col("vector")) & F.col("id").isNotNull())
    fit = fit.withColumn("node", vector_digest(F.col("vector")))
    smallest = fit.withColumn("rank", F.dense_rank().over(Window.partitionBy("node").orderBy("id"))).filter(F.col("rank") <= ids)
    members = F.array_sort(F.collect_set("id"))
    return smallest.groupBy("node").agg(F.first("vector").alias("vector"), members.alias("members"))


def build_index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``shard, start, number, edges, vector, members``: the graphs of all shards, every vector in one of them."""
    classes = cut_lineage(_classes(vectors, F.col(key), F.col(vector), k + 1), "vectors")
    shards = max(1, -(-classes.count() // shard_rows))
    dealt = classes.withColumn("shard", F.concat_ws("/", F.size("vector").cast("string"), F.pmod(F.xxhash64("node"), F.lit(shards)).cast("string")))

    def built(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        edges, start = build_graph(lifted(matrix(rows["vector"])))
        ends = np.cumsum([0, *(edges >= 0).sum(axis=1)], dtype=np.int32)
        lists = pa.ListArray.from_arrays(ends, edges[edges >= 0].astype(np.int32))
        columns = [rows["shard"], pa.array([start] * len(rows), pa.int32()), pa.array(np.arange(len(rows), dtype=np.int32)), lists, rows["vector"], rows["members"]]
        return pa.table(columns, ["shard", "start", "number", "edges", "vector", "members"])

    id_type = vectors.schema[key].dataType.simpleString()
    kind = vectors.schema[vector].dataType.simpleString()
    schema = f"shard string, start int, number int, edges array<int>, vector {kind}, members array<{id_type}>"
    return cut_lineage(dealt.select("shard", "node", "vector", "members").groupBy("shard").applyInArrow(built, schema), "graphs")


def _graph(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, int, list]:
    rows = rows.sort_by("number")
    lists = rows["edges"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    edges = np.full((len(rows), max(1, int(sizes.max(initial=0)))), -1)
    edges[np.arange(edges.shape[1])[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
    return matrix(rows["vector"]), edges, rows["start"][0].as_py(), rows["members"].to_pylist()


def search(index: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, beam: int = SEARCH_BEAM) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for each query but itself, nearest
    first, ties to the smaller id. Queries go through each shard in blocks."""
    asked = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("asked")).filter(usable(F.col("asked")) & F.col("query_id").isNotNull())
    asked = cut_lineage(asked.dropDuplicates(["query_id"]), "queries")
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    asked = asked.withColumns({"length": F.size("asked"), "to_block": F.pmod(F.xxhash64("query_id"), F.lit(blocks))})
    shards = index.select(F.col("shard").alias("to_shard"), F.size("vector").alias("length")).distinct()
    # each block of queries visits each shard: that many copies, not a row per pair of vectors
    visits = asked.join(shards, "length").select("to_shard", "to_block", "query_id", "asked")
    kept = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    id_type = queries.schema[key].dataType.simpleString()

    def found(keys, graph: pa.Table, asking: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(graph) and len(asking):
            vectors, edges, start, members = _graph(graph)
            points, ids, asked_vectors = lifted(vectors), asking["query_id"].to_pylist(), matrix(asking["asked"])
            for at in range(0, len(ids), BATCH):
                some = asked_vectors[at : at + BATCH]
                nodes, _ = beam_search(points, edges, start, np.hstack([some, np.zeros((len(some), 1))]), max(beam, 2 * k))
                for query, vector_, own in zip(ids[at : at + BATCH], some, nodes):
                    _nearest(query, own[own >= 0], vectors, vector_, members, k, out)
        return pa.table([pa.array(out["query_id"], asking["query_id"].type), pa.array(out["vec_id"], graph["members"].type.value_type), pa.array(out["score"], pa.float64())], list(out))

    near = visits.groupBy("to_shard", "to_block").cogroup(kept.groupBy("shard", "block")).applyInArrow(
        lambda keys, asking, graph: found(keys, graph, asking), f"query_id {id_type}, vec_id {id_type}, score double"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _nearest(query, nodes: np.ndarray, vectors: np.ndarray, asked: np.ndarray, members: list, k: int, out: dict[str, list]) -> None:
    """Appends the ``k`` best ids behind the nodes, best score first and smaller ids first at ties."""
    scores = (vectors[nodes] * asked).sum(axis=1)
    pairs: list[tuple[float, object]] = []
    for i in np.argsort(-scores, kind="stable"):
        if len(pairs) >= k and -scores[i] > pairs[k - 1][0]:
            break
        pairs = sorted(pairs + [(-float(scores[i]), m) for m in members[nodes[i]] if m != query])[:k]
    out["query_id"] += [query] * len(pairs)
    out["vec_id"] += [m for _, m in pairs]
    out["score"] += [-s for s, _ in pairs]


def neighbour_report(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The ``k`` nearest of all rows for each row whose id is divisible by ``every``."""
    return search(build_index(vectors, k=k), vectors.filter(F.col("vec_id") % every == 0), k=k)
