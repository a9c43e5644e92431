"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from worldstate.llm import vamana
from worldstate.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, queries, k):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    seen = {}
    for i, v in ok:
        seen.setdefault(i, v)
    out = {}
    for q in queries:
        if q in seen:
            best = sorted((-float((v * seen[q]).sum()), i) for i, v in ok if i != q and len(v) == len(seen[q]))
            out[q] = [(i, -s) for s, i in best[:k]]
    return out


def recall(got, want):
    """Also checks ranks, order and scores of what was found."""
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for q, pairs in want.items():
        mine = sorted(found.get(q, []))
        assert [r for r, _, _ in mine] == list(range(1, len(pairs) + 1))
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        hit += len({i for _, i, _ in mine} & {i for i, _ in pairs})
        total += len(pairs)
    assert set(found) <= set(want)
    return hit / max(1, total)


@pytest.mark.parametrize("shard_rows", [8192, 150])
def test_recall_on_odd_vectors(spark, shard_rows):
    rng = np.random.default_rng(4)
    rows = [(i, np.float32(rng.standard_normal(24) * rng.choice([0.3, 1, 3])).tolist()) for i in range(900)]
    rows += [(2000 + i, rows[0][1]) for i in range(60)]  # copies: ties go to smaller ids
    rows += [(3000, None), (3001, []), (3020, [0.0] * 24), (3002, [float("nan")] * 24), (3003, [None] + [1.0] * 23), (None, rows[1][1]), rows[40]]
    rows += [(4000 + i, [1.0, float(i)]) for i in range(5)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(4)
    index = vamana.build_index(df, shard_rows=shard_rows)
    got = vamana.search(index, df.filter("vec_id % 20 = 0")).collect()
    want = brute(rows, [i for i, _ in rows if i is not None and i % 20 == 0], 20)
    assert recall(got, want) >= 0.98
    exact = {q: [i for i, _ in p] for q, p in want.items()}
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 0] == exact[0]
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 4000] == exact[4000]


def test_query_recall(spark):
    folder = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = QUERIES["op3_pruned_graph_neighbours"](spark, folder).collect()
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 20)
    assert recall(got, want) >= 0.95
    for r in got:
        assert abs(r.score - dict(want[r.query_id]).get(r.vec_id, r.score)) < 1e-9


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], ""), (20, [2.0, 1.0], ""), (3, [0.5, 0.5], "")], SCHEMA)
    got = {(r.query_id, r["rank"]): r.vec_id for r in vamana.neighbour_report(df).collect()}
    assert got == {(0, 1): 20, (0, 2): 3, (20, 1): 0, (20, 2): 3}
    assert vamana.neighbour_report(df.limit(0)).count() == 0
    assert vamana.neighbour_report(df.filter("vec_id = 0")).count() == 0
