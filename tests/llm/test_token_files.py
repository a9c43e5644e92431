"""Files of token ids against the library, plain Huffman codes and sums by hand."""

import heapq
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from worldstate.llm import huffman as H
from worldstate.session import fresh_dir

SCHEMA = "doc_id long, text string, start string, n_tokens double, ids int, part string, width string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def plain_cost(counts):
    heap, cost = [c for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a + b
        heapq.heappush(heap, a + b)
    return cost


def test_lengths_are_best_and_canonical():
    rng = np.random.default_rng(1)
    for counts in (rng.integers(0, 50, 300), np.array([0, 3]), np.array([5, 0, 9]), np.ones(64, int), (2.0 ** np.arange(12)).astype(int)):
        lengths = H.code_lengths(counts, 30)
        used = lengths > 0
        assert (used == (counts > 0)).all()
        if used.sum() > 1:
            assert (lengths.astype(int) * counts).sum() == plain_cost(counts.tolist()) and (0.5 ** lengths[used]).sum() == 1
        book = H.Codebook(lengths)
        codes = [f"{int(book.codes[i]):0{lengths[i]}b}" for i in np.lexsort((np.arange(len(lengths)), lengths)) if lengths[i]]
        assert codes == sorted(codes) and not any(b.startswith(a) for a, b in zip(codes, codes[1:]))
    assert H.code_lengths(np.zeros(5, int)).tolist() == [0] * 5


@pytest.mark.parametrize("longest", [4, 5, 9])
def test_length_limit(longest):
    counts = (1.7 ** np.arange(16)).astype(int) + 1

    def best(i, left, memo={}):  # noqa: B006
        """Least cost of the symbols from the i-th rarest on, with ``left`` of 2^longest code space."""
        key = (longest, i, left)
        if key not in memo:
            tries = [(1 << (longest - n), n) for n in range(1, longest + 1)]
            memo[key] = 0 if i == 16 else min((c + n * int(counts[i]) for space, n in tries if space <= left and (c := best(i + 1, left - space)) is not None), default=None)
        return memo[key]

    lengths = H.code_lengths(counts, longest)
    assert lengths.max() <= longest and (0.5 ** lengths).sum() <= 1
    assert (lengths.astype(int) * counts).sum() == best(0, 1 << longest)


def test_pack_and_unpack():
    rng = np.random.default_rng(2)
    book = H.Codebook(H.code_lengths(np.bincount(rng.geometric(0.01, 50_000), minlength=4000)))
    used = np.flatnonzero(book.lengths)
    blocks = [rng.choice(used, n) for n in (1, 255, 256, 257, 5000)]
    packed = [book.pack(b) for b in blocks]
    bits = "".join(f"{int(book.codes[i]):0{book.lengths[i]}b}" for i in blocks[1])
    assert bin(int.from_bytes(b"\1" + packed[1][0], "big"))[3:].startswith(bits) and len(packed[1][0]) == -(-len(bits) // 8)
    out = book.unpack([p for p, _ in packed], [c for _, c in packed], [len(b) for b in blocks], book.table)
    assert (out == np.concatenate(blocks)).all()
    single = H.Codebook(H.code_lengths(np.array([0, 0, 7])))
    payload, marks = single.pack(np.full(300, 2))
    assert (single.unpack([payload], [marks], [300], single.table) == 2).all()


def odd_texts():
    rng = random.Random(3)
    parts = ["The", "don't", "l'été", "Straße", "İI", "<|endoftext|>", "<|ENDOFTEXT|>", "a<|startoftext|>b", "Ωσ", "ΑΣ", "日本", "é", "\x1c", "\x85", " ", "12,3.4", "…", "😀", "\n", "\t", "we'LL", "x" * 300]
    return [" ".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(300)]


def test_files_round_trip(spark, library, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_IDS", 500)
    texts = [None, "", *odd_texts(), "word " * 60_000 + "ende", "z" * 70_000]
    rows = [(i * 7 % 1009 if i else None, t) for i, t in enumerate(texts)] + [(5, "same row")] * 3
    df = spark.createDataFrame([(k, t, "x", 0.5, 1, "y", "z") for k, t in rows], SCHEMA).repartition(5)
    path = fresh_dir(spark, "token-files")
    H.write_ids(H.text_ids(df), path)
    got = sorted(H.read_ids(spark, path).collect(), key=lambda r: r.start)
    want = sorted((k is not None, k or 0, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for k, t in rows)
    assert [(r.key is not None, r.key or 0) for r in got] == [w[:2] for w in want]
    assert sorted((r.key is not None, r.key or 0, r.ids) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *[r.n_ids for r in got]])[:-1].tolist()
    sums = {(r.key, r.start): r.crc32 for r in H.read_checksums(spark, path).collect()}
    assert sums == {(r.key, r.start): zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.filter("n > 500 and size(keys) > 1").count() == 0 and blocks.count() > 20


def test_empty_table_and_report(spark, small, library):
    assert H.id_report(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts, start = {r.doc_id: r.text for r in docs.collect()}, 0
    for r in sorted(H.id_report(docs).collect()):
        ids = np.array([*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert tuple(r) == (r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
