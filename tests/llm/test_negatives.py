"""Hard negatives against a plain search over all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from worldstate.llm import bond

SCHEMA = "vec_id long, label int, embedding array<double>, row string, place int, score double, shard int"


def plain(rows, positives, negatives, low, high, scale=256):
    """rows: (key, label, vector) in any order; keys whose hundredth part is whole are anchors."""
    usable = [(k, n, [math.floor(x * scale) for x in v]) for k, n, v in rows if k is not None and n is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for key, label, vector in usable:
        if key % 10:
            continue
        scored = sorted(((sum(a * b for a, b in zip(vector, v)), k, n) for k, n, v in usable if k != key), key=lambda s: (-s[0], s[1]))
        for score, other, _ in [s for s in scored if s[2] == label][:positives]:
            inside = [s for s in scored if s[2] != label and low * score <= 100 * s[0] <= high * score]
            out += [(key, other, r + 1, s[1], score, s[0]) for r, s in enumerate(inside[:negatives])]
    return sorted(out)


def search(spark, rows, shard_values=bond.SHARD_VALUES, **limits):
    df = spark.createDataFrame([(*r, "x", 1, 0.5, 3) for r in rows], SCHEMA)
    found = bond.hard_negatives(df, F.col("vec_id") % 10 == 0, shard_values=shard_values, **limits)
    return sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("shard_values", [1 << 22, 400])
def test_all_pairs(spark, shard_values):
    rng = np.random.default_rng(5)
    rows = [(k, int(rng.integers(3)), rng.normal(0, rng.choice([0.1, 1.0]), 12).tolist()) for k in range(240)]
    rows += [(240 + k, k % 3, rows[7][2]) for k in range(60)]  # many copies of one vector, ties by key
    rows += [(400 + k, 9, [0.0] * 12) for k in range(30)]
    want = plain(rows, 3, 4, 30, 90)
    assert want and search(spark, rows, shard_values, positives=3, negatives=4) == want


def test_odd_rows(spark):
    rows = [
        (None, 1, [1.0, 0.0]), (10, None, [1.0, 0.0]), (20, 1, None), (30, 1, [None, 1.0]), (40, 1, [math.nan, 1.0]), (50, 1, [math.inf, 1.0]),
        (60, 1, []), (70, 1, [1.0]), (80, 2, [0.5, 0.5, 0.25]), (80, 2, [0.5, 0.5, 0.25]), (1, 1, [0.75, 0.5]), (2, 1, [0.25]), (3, 2, [0.5, 0.25]),
        (90, 1, [-1.0, -1.0]), (4, 1, [1.0, 1.0]), (5, 2, [0.9, 0.75, 0.1]),
    ]
    assert search(spark, rows) == plain(rows, 5, 10, 30, 90)
    assert search(spark, []) == []


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(k, k % 2, [float(x) for x in rng.integers(-(2**20), 2**20, 6)]) for k in range(1, 60)] + [(60, 0, [2.0**20] * 6)]
    want = plain(rows, 5, 10, 10, 95)
    assert want and search(spark, rows, low=10, high=95) == want


def test_bitmap_shrinks_before_the_last_column():
    import pyarrow as pa

    rng = np.random.default_rng(7)
    scales = 0.5 ** np.arange(32)
    vectors = rng.normal(0, 1, (500, 32)) * scales
    table = pa.table({"key": np.arange(500), "label": np.zeros(500, int), "vector": pa.array(vectors.tolist())})
    shard, seen = bond.Shard(table, 32, 256), []

    def needed(lower, upper):
        seen.append(len(lower))
        return upper >= bond._at_least(lower, 3)

    rows, _ = shard.scores(np.floor(vectors[0] * 256), shard.rows(0, True), needed)
    assert seen[0] == 500 and seen[1] < 50 and len(rows) >= 3
