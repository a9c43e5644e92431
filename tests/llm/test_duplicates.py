"""Near-duplicate operators against brute force over all pairs."""

import re


import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from worldstate.llm import pstable, simhash
from worldstate.llm.graphs import Forest, connected_components
from worldstate.llm.queries import QUERIES


def components(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("n,m", [(1, 0), (30, 20), (200, 190), (400, 399)])
def test_components(spark, n, m):
    rng = np.random.default_rng(n)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2))] if m != n - 1 else [(i, i + 1) for i in range(m)]
    want = components(n, pairs)
    forest = Forest(n)
    forest.link(np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int))
    assert forest.root.tolist() == want
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: want[i] for i in {x for p in pairs for x in p} if want.count(want[i]) > 1}


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_query(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    ids = sorted(docs)
    prints = [plain_fingerprint(docs[i]) for i in ids]
    pairs = [(a, b) for a in range(len(ids)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    want = components(len(ids), pairs)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op4_simhash_trees"](spark, small).collect()}
    assert got == {i: (f"{prints[k]:016x}", ids[want[k]]) for k, i in enumerate(ids)}


def test_simhash_odd_texts(spark):
    long = " ".join(f"w{i}" for i in range(70_000))
    texts = [None, "", " \t\r\n", "One", "ONE", "éÉ é", "a b c", "a b c d", long, long + " end", "\x0b x\x0cy", "  z"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, "One", "clash")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")).collect()
    assert len(got) == len(rows)
    of = {r.doc_id: r for r in got}
    assert all(int(of[i].fingerprint, 16) == plain_fingerprint(t) for i, t in enumerate(texts))
    assert [of[i].component_id for i in (0, 1, 2, 3, 4, 8, 9)] == [0, 0, 0, 3, 3, 8, 8]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trees_lose_no_link(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(-(2**63), 2**63, 150, dtype=np.int64)
    points = [int(c) for c in centres]
    for c in np.concatenate([centres, np.repeat(centres[:1], 1500)]):  # one dense ball
        flips = rng.choice(64, rng.integers(1, 7), replace=False)
        mask = int(sum(1 << int(b) for b in flips))
        points.append(int(np.uint64(int(c) & (2**64 - 1) ^ mask).astype(np.int64)))
    points = sorted(set(points))
    own = np.array(points, np.int64).view(np.uint64)
    pairs = [(i, int(j)) for i in range(len(own)) for j in np.flatnonzero(np.bitwise_count(own[:i] ^ own[i]) <= 4)]
    want = components(len(points), pairs)
    table = spark.createDataFrame([(p,) for p in points], "fingerprint long").repartition(3)
    got = {r.node: r.root for r in connected_components(simhash.near_links(table, shard_rows=100)).collect()}
    assert {p: got.get(p, p) for p in points} == {p: points[w] for p, w in zip(points, want)}


def brute_links(rows, threshold=0.98):
    """n_links and component per row of (id, vector, label)."""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and lab is not None for _, v, lab in rows]
    pairs = []
    for i, (_, v, lab) in enumerate(rows):
        for j in range(i):
            w = rows[j][1]
            if ok[i] and ok[j] and lab == rows[j][2] and len(v) == len(w):
                x, y = np.array(v, np.float64), np.array(w, np.float64)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    pairs.append((i, j))
    links = [0] * len(rows)
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    return links, components(len(rows), pairs)


VEC = "vec_id long, embedding array<float>, label int, n_links string"


@pytest.mark.parametrize("block", [2048, 3])
def test_near_vectors_by_brute_force(spark, block):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((12, 16))
    rows = [(b + rng.standard_normal(16) * rng.choice([0, 0.02, 0.05, 0.1])).tolist() for b in base for _ in range(6)]
    rows = [(np.float32(v).tolist(), i % 2) for i, v in enumerate(rows)]
    rows += [(None, 0), ([], 0), ([0.0] * 16, 0), ([1.0, None], 0), ([float("nan")] + [1.0] * 15, 0), ([float("inf")] * 16, 1), (rows[0][0], None), (rows[0][0], 0), (rows[0][0][:8], 0), (rows[0][0][:8], 0)]
    rows = [(i, v, lab) for i, (v, lab) in enumerate(rows)]
    links, comp = brute_links(rows)
    got = pstable.near_vectors(spark.createDataFrame([(*r, "clash") for r in rows], VEC), block_rows=block).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (links[i], comp[i], comp[i] == i) for i, _, _ in rows}
    assert len(got) == len(rows)


def test_vectors_of_extreme_norms(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=8)
    rows = [(i, (base * scale).tolist(), 1, "x") for i, scale in enumerate([1e-200, 2e-200, 3e-310, 1.0, 5e180, 1e300])] + [(9, (-base * 1e-200).tolist(), 1, "x")]
    got = {r.vec_id: (r.n_links, r.component_id) for r in pstable.near_vectors(spark.createDataFrame(rows, VEC.replace("float", "double"))).collect()}
    assert got == {i: (5, 0) for i in range(6)} | {9: (0, 9)}


def test_near_vectors_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding", "label").orderBy("vec_id").collect()]
    links, comp = brute_links(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in QUERIES["op5_pstable_embeddings"](spark, small).collect()}
    assert got == {rows[i][0]: (links[i], rows[comp[i]][0]) for i in range(len(rows))}
    assert pstable.near_vectors(spark.createDataFrame([], VEC)).count() == 0


def shingle_sets(texts, words=5):
    lowered = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") for t in texts]
    split = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in lowered]
    return [frozenset(" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset() for w in split]


def kept_by_sets(texts):
    """Least index of each component at a Jaccard similarity of 0.8, and the pairs that link."""
    sets = shingle_sets(texts)
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return set(components(len(texts), pairs)), pairs


def edited(rng, words, edits, name):
    changed = list(words)
    for k in rng.choice(len(words), edits, replace=False):
        changed[k] = f"new{name}_{k}"
    return changed


@pytest.mark.parametrize("most,most_bytes", [(simhash.SHARD_SETS, simhash.SET_BYTES), (6, 9000)])
def test_sets_link_at_four_fifths(spark, monkeypatch, most, most_bytes):
    """Also with shards so small that all groups of copies are cut by more keys, and then into blocks."""
    monkeypatch.setattr(simhash.sketch_links, "__defaults__", (*simhash.sketch_links.__defaults__[:-1], most))
    monkeypatch.setattr(simhash.set_links, "__defaults__", (*simhash.set_links.__defaults__[:-1], most_bytes))
    rng = np.random.default_rng(11)
    texts = [None, "", "one", "One", "a b c d e", "a b c d e f"]
    for base, edits in enumerate([0, 1, 2, 4, 6, 8, 12, 20, 40] * 3):  # from alike to unlike, either side of 0.8
        words = [f"w{base}_{k}" for k in range(rng.integers(120, 400))]
        texts += [" ".join(words), " ".join(edited(rng, words, edits, base)), " ".join(words + words[:9]), " ".join(words[: len(words) * 9 // 10])]
    hot = [f"h{k}" for k in range(200)]
    texts += [" ".join(edited(rng, hot, 2, f"hot{k}")) for k in range(40)]
    want, pairs = kept_by_sets(texts)
    prints = [simhash.fingerprint(t, 5) for t in texts]
    assert sum((prints[a] ^ prints[b] & (2**64 - 1)).bit_count() > 4 for a, b in pairs) > 9
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in simhash.keep_unlike(docs).collect()} == want


def test_recall_of_independent_pairs(spark):
    """Pairs made at similarities from 0.8 to 1, in texts of 14 to 300 shingles; 0.99 of them are found."""
    rng = np.random.default_rng(12)
    texts, n = [], 0
    while n < 400:
        words = [f"p{n}_{k}" for k in range(int(rng.choice([18, 34, 84, 304])))]
        pair = [" ".join(words), " ".join(edited(rng, words, int(rng.integers(1, 1 + max(1, len(words) // 45))), n))]
        a, b = shingle_sets(pair)
        if 5 * len(a & b) >= 4 * len(a | b):
            texts, n = texts + pair, n + 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r.doc_id for r in simhash.keep_unlike(docs).collect()}
    assert left >= set(range(0, 800, 2)) and len(left) - 400 <= 4


def test_unlike_rows_stay_whole(spark):
    rows = [(i, f"text number {i} has words of its own {i * 7} {i * 11}", "x", i % 2 == 0) for i in range(30)] + [(None, "no key here at all", None, None), (7, None, None, None)]
    rows += [(40, "one row that stands often", "y", None)] * 5 + [(None, "one row that stands often", "y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `__rows` string, node boolean").repartition(3)
    got = simhash.keep_unlike(docs)
    assert got.columns == docs.columns and sorted(map(repr, got.collect())) == sorted(map(repr, docs.filter("doc_id is not null or text like 'no%'").distinct().collect()))
    assert simhash.keep_unlike(docs.limit(0)).count() == 0
