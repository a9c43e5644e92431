"""Line dedup, mixing and sharding against plain computations."""

import heapq
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from worldstate.llm import linededup, mixing, sharding
from worldstate.llm.numbering import digest_of, key_text, number_rows
from worldstate.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, slot string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "clash") for i, t, s in rows], DOCS).repartition(3)


@pytest.mark.parametrize("name", ["op2_line_dedup", "op7_pfair_mix"])
def test_sql(spark, small, name):
    from tests.oracle import compare, connect

    assert compare(spark, connect(small), name, QUERIES[name], ORACLES[name], small) == ""


def test_number_rows_is_gapless(spark):
    rows = [(None, i // 2) for i in range(40)] + [("", i) for i in range(9)] + [("a", None)] * 5
    df = spark.createDataFrame(rows, "k string, v int")
    got = defaultdict(list)
    for r in number_rows(df, key_text(F.col("k")), digest_of(F.col("v")), "n", (F.col("v"),)).collect():
        got[r.k].append(r.n)
    assert {k: sorted(v) for k, v in got.items()} == {None: list(range(40)), "": list(range(9)), "a": list(range(5))}


LINES = [
    (1, "menu\nalpha\n\nbeta", "h"), (2, " menu \nalpha2", "h"), (3, "menu\nmenu", "h"), (4, "x", "h"), (4, "x", "h"), (5, None, "h"), (6, "", "h"),
    (7, "menu\ny", "g"), (8, "menu", None), (9, "menu\nz", None), (10, "menu\n" + "long " * 50_000, None),
]


def test_lines_by_brute_force(spark):
    ratio, least = 0.3, 2
    sites, seen = Counter(s for _, _, s in LINES), Counter()
    for _, t, s in LINES:
        for line in {x.strip(" ") for x in (t or "").split("\n")} - {""}:
            seen[s, line] += 1
    bad = {k for k, n in seen.items() if n >= least and n > ratio * sites[k[0]]}
    want = sorted((i, None if t is None else "\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in bad), s or "") for i, t, s in LINES)
    got = linededup.drop_boilerplate(table(spark, LINES), ratio=ratio, min_pages=least, dropped="n").collect()
    assert sorted((r.doc_id, r.text, r.source or "") for r in got) == want
    assert {r.slot for r in got} == {"clash"} and {r.doc_id: r.n for r in got}[3] == 2
    assert linededup.drop_boilerplate(table(spark, LINES).limit(0)).count() == 0


def test_lines_by_host_of_url(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").withColumn("host", F.parse_url("url", F.lit("HOST")))
    pages = pages.withColumn("html", F.when(F.col("page_id") % 2 == 0, F.concat("html", F.lit("\n footer of "), "host")).otherwise(F.col("html")))
    rows = pages.collect()
    sites, seen = Counter(r.host for r in rows), Counter()
    for r in rows:
        seen.update({(r.host, x.strip(" ")) for x in r.html.split("\n")} - {(r.host, "")})
    bad = {k for k, n in seen.items() if n >= 2 and n > linededup.RATIO * sites[k[0]]}
    want = {r.page_id: "\n".join(x for x in r.html.split("\n") if (r.host, x.strip(" ")) not in bad) for r in rows}
    assert bad and {r.page_id: r.html for r in linededup.drop_boilerplate(pages, "host", "html").collect()} == want


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_lines_of_small_hosts(spark, n):
    rows = [(i, f"footer\nown line {i}", "h") for i in range(n)] + [(9, "footer", "other")]
    got = {r.doc_id: r.text for r in linededup.drop_boilerplate(table(spark, rows)).collect()}
    assert got == {i: f"own line {i}" if n > 1 else f"footer\nown line {i}" for i in range(n)} | {9: "footer"}


def fluid_edges(weights, blocks):
    """Per source the times at which its blocks begin and end when all are served at once, by weight."""
    edges = {}
    for s, w in weights.items():
        edges[s] = []
        for j in range(blocks[s] + 1):
            at = Fraction(j, w)
            edges[s].append(sum(min(Fraction(blocks[k]), weights[k] * at) for k in weights))
    return edges


def one_by_one(weights, blocks):
    """Slots of all blocks, found slot after slot."""
    edges, done, found = fluid_edges(weights, blocks), Counter(), {}
    for slot in range(sum(blocks.values())):
        open_ = [(math.ceil(edges[s][done[s] + 1]), "" if s is None else "=" + s, s) for s in weights if done[s] < blocks[s] and math.floor(edges[s][done[s]]) <= slot]
        due, _, s = min(open_, key=lambda x: x[:2])
        found[s, done[s]] = (slot, math.floor(edges[s][done[s]]), due)
        done[s] += 1
    return found


def mixed_blocks(got):
    return {(r.source, r.block): (r.slot, r.release, r.deadline) for r in got}


PARTS = {"a": 5, "b": 3, None: 2}


@pytest.mark.parametrize("frame", [8, 1024])
@pytest.mark.parametrize("sizes", [{"a": 300, "b": 37, "c": 5, None: 1}, {"a": 1}, {"a": 64, "b": 64, "c": 64}, {f"s{i}": 3 + i for i in range(30)} | {"a": 120}])
def test_mix_is_earliest_deadline_first(spark, sizes, frame):
    rows = [(i, "t", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    got = mixing.mix(table(spark, rows), parts=PARTS, block_rows=2, least_frame=frame).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(rows)))
    found = mixed_blocks(got)
    assert sorted(s for s, _, _ in found.values()) == list(range(len(found)))
    weights, blocks = {s: PARTS.get(s, 1) for s in sizes}, {s: -(-n // 2) for s, n in sizes.items()}
    assert found == one_by_one(weights, blocks)
    # each source is less than a block from its share at any slot, also when others have run out
    order, edges, had = [s for (s, _), _ in sorted(found.items(), key=lambda x: x[1][0])], fluid_edges(weights, blocks), Counter()
    for t, s in enumerate(order, 1):
        had[s] += 1
        for x in sizes:  # by time t between begun - 1 and begun blocks are served
            whole = sum(e <= t for e in edges[x]) - 1
            begun = sum(e < t for e in edges[x][:-1])
            assert whole <= had[x] <= begun


@pytest.mark.parametrize("n,rows,hot", [(20, 200, 2000), (300, 6, 900), (1000, 4, 2000)])
def test_mix_follows_exact_weights(spark, n, rows, hot):
    sizes = {f"s{i}": rows for i in range(n - 1)} | {"hot": hot}
    docs = [(i, "t", s) for i, s in enumerate(s for s, k in sizes.items() for _ in range(k))]
    got = mixing.mix(table(spark, docs), block_rows=1).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(docs))) and sorted(r.slot for r in got) == list(range(len(docs)))
    assert all(r.release <= r.slot < r.deadline for r in got)
    weights = {s: math.floor(1000 * k**0.5 + 0.5) for s, k in sizes.items()}
    total = sum(weights.values())
    order, had = [r.source for r in sorted(got, key=lambda r: r.slot)], Counter()
    lasting = int(min(Fraction(k * total, weights[s]) for s, k in sizes.items()))  # until the first source runs out
    assert lasting > n
    for t, s in enumerate(order[:lasting], 1):
        had[s] += 1
        if t % 7 == 0 or n == 20:
            assert all(abs(had[x] - Fraction(w * t, total)) < 1 for x, w in weights.items())


@pytest.mark.parametrize("scale", [30, 4000])
def test_same_rule_at_every_size(spark, scale):
    sizes, parts = {"a": 7 * scale, "b": 2 * scale, "c": scale}, {"a": 7, "b": 2, "c": 1}
    docs = spark.range(sum(sizes.values())).select(F.col("id").alias("doc_id"), F.expr(f"case when id < {7 * scale} then 'a' when id < {9 * scale} then 'b' else 'c' end").alias("source"))
    got = mixing.mix(docs, parts=parts, block_rows=4, least_frame=64).filter("slot < 60 and place = 0").collect()
    order = "".join(r.source for r in sorted(got, key=lambda r: r.slot))
    assert order[:10] == order[10:20] == order[50:60] and Counter(order[:10]) == {"a": 7, "b": 2, "c": 1}


def test_mix_of_nothing_and_written_order(spark):
    none = table(spark, LINES).limit(0)
    assert mixing.mix(none).count() == 0 and mixing.arranged(none, 10).count() == 0
    rows = [(i, "t", "ab"[i % 7 == 0]) for i in range(200)]
    mixed = mixing.mix(table(spark, rows), block_rows=2)
    got = [(r.slot, r.place) for r in mixing.in_order(mixed, 5, 100).collect()]
    assert got == sorted(got) and len(got) == 200


def test_arranged_keeps_whole_rows(spark):
    rows = [(i // 2, f"text {i // 3}", [None, "a", "b"][i % 3]) for i in range(90)] + [(7, None, None), (None, "x", "a"), (None, None, None)] + [(5, "same", "b")] * 6
    df = table(spark, rows)
    got = mixing.arranged(df, 20).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, df.collect()))
    assert {r.source for r in got[:16]} == {None, "a", "b"}


def test_mix_is_native(spark, small):
    plan = QUERIES["op7_pfair_mix"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_pour_equals_heap():
    rng = random.Random(3)
    for _ in range(200):
        loads, size, n = [rng.randrange(60) for _ in range(rng.randrange(1, 7))], rng.randrange(1, 30), rng.randrange(80)
        heap, want = [(load, i) for i, load in enumerate(loads)], [0] * len(loads)
        heapq.heapify(heap)
        for _ in range(n):
            load, i = heapq.heappop(heap)
            want[i] += 1
            heapq.heappush(heap, (load + size, i))
        assert sharding._pour(loads, size, n) == want


def test_shards_keep_groups_and_balance(spark):
    texts = ["hot " * 50] * 120 + [("w%d " % i) * (i % 90) for i in range(700)] + [None, "", "é" * 500]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(5, texts[5], "s")]
    got = sharding.shard_report(table(spark, rows), 4).collect()
    assert len(got) == len(rows)
    of, slots, load = defaultdict(set), defaultdict(list), Counter()
    for r in got:
        text = texts[r.doc_id] or ""
        assert (r["size"], r.text_crc32, r.law) == (len(text.encode()) + 16, zlib.crc32(text.encode()), "bytes")
        of[text].add(r.shard)
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    assert all(len(s) == 1 for s in of.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    biggest = max(Counter({t: sum(len((x or "").encode()) + 16 for x in texts if (x or "") == t) for t in of}).values())
    assert max(load.values()) - min(load.values()) < biggest
    assert sharding.shard_report(table(spark, rows).limit(0)).count() == 0


def test_shard_query_is_balanced(spark, small):
    load = Counter()
    for r in QUERIES["op9_longest_first_shards"](spark, small).collect():
        load[r.shard] += r["size"]
    assert len(load) == 40
