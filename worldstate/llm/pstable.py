"""Embedding near-duplicates by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions and quantised with a random shift; some
projections together name a bucket, in several tables. Vectors that share a bucket are compared
by exact cosine. A pair counts in the first table it shares only, so counts need no list of pairs.

Links need equal labels that are not null and vectors of equal length. Vectors that are null, zero,
or hold null or non-finite components link with nothing. Equal vectors are one node with a
multiplicity. Buckets larger than a block are compared block by block, so no task holds a hot
bucket. At cosine 0.98 (distance 0.2) a table with width 1 and six directions joins a pair with
probability 0.35; 20 tables miss about 2 in 10,000 such pairs, and fewer above.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worldstate.llm.graphs import Forest, connected_components
from worldstate.llm.vectors import balanced, matrix, usable, vector_digest
from worldstate.session import cut_lineage

COSINE = 0.98
TABLES = 20
DIRECTIONS = 6
WIDTH = 1.0
BLOCK_ROWS = 2048
TASK_ROWS = 8192


def bucket_hashes(vectors: np.ndarray, tables: int, directions: int, width: float) -> np.ndarray:
    """One 64-bit bucket per row and table; the same directions for all vectors of this length."""
    rng = np.random.default_rng([vectors.shape[1], tables, directions])
    axes = rng.standard_normal((vectors.shape[1], tables * directions))
    cells = np.floor(vectors @ axes / width + rng.random(tables * directions)).astype(np.int64)
    factors = rng.integers(1, 2**63, directions, dtype=np.int64).astype(np.uint64) | np.uint64(1)
    mixed = (cells.reshape(len(cells), tables, directions).view(np.uint64) * factors).sum(axis=2, dtype=np.uint64)
    return mixed.view(np.int64)


def _with_buckets(classes: DataFrame, tables: int, directions: int, width: float) -> DataFrame:
    @F.arrow_udf("array<long>")
    def hashed(column: pa.Array) -> pa.Array:
        lengths = np.array([len(v) for v in column])
        out = np.empty((len(column), tables), np.int64)
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            own = balanced(matrix(column.take(pa.array(rows))))
            out[rows] = bucket_hashes(own / np.linalg.norm(own, axis=1, keepdims=True), tables, directions, width)
        ends = np.arange(0, out.size + 1, tables, dtype=np.int32)
        return pa.ListArray.from_arrays(ends, out.reshape(-1))

    return classes.withColumn("buckets", hashed("vector"))


def _compared(threshold: float):
    """Links within the cells of one task: how many vectors each row links with, and a spanning forest."""

    def compare(rows: pa.Table) -> pa.Table:
        order = np.lexsort([rows[c].to_numpy() for c in ("right", "left", "bucket", "t", "space")])
        rows = rows.take(pa.array(order))
        marks = np.stack([rows[c].to_numpy() for c in ("space", "t", "bucket", "left", "right")], axis=1)
        opens = np.flatnonzero(np.r_[True, (marks[1:] != marks[:-1]).any(axis=1)])
        nodes, number = np.unique(rows["node"].to_numpy(zero_copy_only=False), return_inverse=True)
        copies, block = rows["copies"].to_numpy(), rows["own"].to_numpy()
        buckets = rows["buckets"].combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
        vectors = rows["vector"].combine_chunks()
        forest, links = Forest(len(nodes)), np.zeros(len(nodes), np.int64)
        for at, end in zip(opens, np.r_[opens[1:], len(rows)]):
            if end - at < 2:
                continue
            own = balanced(matrix(vectors.slice(at, end - at)))
            norms = np.linalg.norm(own, axis=1)
            t, first, second = marks[at, 1], block[at:end] == marks[at, 3], block[at:end] == marks[at, 4]
            a, b = np.flatnonzero(first), np.flatnonzero(second)
            i, j = np.nonzero(own[a] @ own[b].T >= (threshold - 1e-9) * norms[a][:, None] * norms[b][None, :])
            i, j = a[i], b[j]
            if marks[at, 3] == marks[at, 4]:
                i, j = i[i < j], j[i < j]
            exact = np.einsum("ij,ij->i", own[i], own[j]) / (norms[i] * norms[j]) >= threshold
            i, j = i[exact] + at, j[exact] + at
            new = ~(buckets[i, :t] == buckets[j, :t]).any(axis=1)
            i, j = i[new], j[new]
            np.add.at(links, number[i], copies[j])
            np.add.at(links, number[j], copies[i])
            forest.link(number[i], number[j])
        child, root = forest.edges()
        linked = np.flatnonzero(links)
        kinds = {"a": [nodes[linked], nodes[child]], "b": [[None] * len(linked), nodes[root]], "links": [links[linked], [0] * len(child)]}
        columns = {k: [x for part in v for x in part] for k, v in kinds.items()}
        return pa.table({"a": pa.array(columns["a"], pa.binary()), "b": pa.array(columns["b"], pa.binary()), "links": pa.array(columns["links"], pa.int64())})

    return compare


def near_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = COSINE,
    tables: int = TABLES, directions: int = DIRECTIONS, width: float = WIDTH, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``key, n_links, component_id, kept`` for every row. Repeated rows count as copies of one another.

    A row with a null key takes part; it names its component only if no other row does.
    """
    fit = usable(F.col(vector)) & F.col(label).isNotNull()
    marked = vectors.select(
        F.col(key).alias("key"), F.col(vector).alias("vector"), F.xxhash64(F.col(label), F.size(vector)).alias("space"),
        F.when(fit, F.unhex(F.md5(F.concat_ws("|", F.col(label).cast("string"), F.hex(vector_digest(F.col(vector)))).cast("binary")))).alias("node"),
    )
    grouped = marked.filter("node is not null").groupBy("node")
    classes = grouped.agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("space").alias("space"), F.first("vector").alias("vector"))
    classes = cut_lineage(_with_buckets(classes, tables, directions, width), "buckets")

    spread = classes.select("space", F.posexplode("buckets").alias("t", "bucket"))
    counts = spread.groupBy("space", "t", "bucket").agg(F.count(F.lit(1)).alias("n"))
    large = cut_lineage(counts.filter(F.col("n") > block_rows).withColumn("parts", F.ceil(F.col("n") / block_rows)).drop("n"), "large")
    rows = classes.select("node", "copies", "space", "vector", "buckets", F.posexplode("buckets").alias("t", "bucket"))
    rows = rows.join(large, ["space", "t", "bucket"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), "parts"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumns({"left": F.least("own", "other"), "right": F.greatest("own", "other")})
    tasks = max(1, -(-classes.count() * tables // TASK_ROWS))
    rows = rows.withColumn("task", F.pmod(F.xxhash64("space", "t", "bucket", "left", "right"), F.lit(tasks)))
    found = rows.select("task", "node", "copies", "space", "vector", "buckets", "t", "bucket", "own", "left", "right").groupBy("task")
    found = cut_lineage(found.applyInArrow(_compared(threshold), "a binary, b binary, links long"), "links")

    direct = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.filter("b is not null").select("a", "b"))
    rooted = classes.select("node", "least", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    facts = rooted.join(named, "root").join(direct, "node", "left")
    facts = facts.select("node", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = marked.select("key", "node").join(facts, "node", "left")
    component = F.coalesce("component", "key")
    return out.select(
        F.col("key").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.equal_null(F.col("key"), component).alias("kept"),
    )
