"""Encoding, decoding and token counts against the libraries themselves."""

import hashlib

import pytest
import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from worldstate.llm import bytebpe, tokencount
from worldstate.llm.queries import QUERIES

ODD = [
    None, "", " ", "\n\n  \n", "don't  stop   ", "a" * 3000, "ab " * 60_000, "éè 你好 \U0001f600\U0001f3fd", "<|endoftext|> x <|startoftext|>",
    "İstanbul ΑΣ ς é ẛ̣", "\x85\x1c x", "0123456789 3.14 ½ Ⅷ", "A<|ENDOFTEXT|>'S we'LL", "՘꟎ x", " leading", "x" * 70_000 + " " + "y" * 10,
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 7) for i, t in enumerate(ODD)], "doc_id long, text string, ids int").repartition(3)


@pytest.fixture(scope="module")
def reference():
    ranks = bytebpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encode_equals_library_and_replaces_clashing_column(odd, reference):
    got = {r.doc_id: r for r in bytebpe.encode(odd).collect()}
    for i, t in enumerate(ODD):
        assert list(got[i].ids) == reference.encode_ordinary(t or ""), t
        _, starts = reference.decode_with_offsets(list(got[i].ids))
        assert list(got[i].starts) == starts


def test_decode_round_trip_and_split_characters(spark, odd):
    back = {r.doc_id: bytes(r.decoded) for r in bytebpe.decode(bytebpe.encode(odd)).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(ODD)}
    ids = bytebpe.codec(P.path(bytebpe.RANKS), P.PATTERN).encode("\U0001f3fd").tolist()
    assert len(ids) > 1
    cut = spark.createDataFrame([(0, ids[:1]), (1, ids[1:]), (2, None)], "k int, ids array<int>")
    rows = {r.k: r for r in bytebpe.decode(cut).withColumn("shown", bytebpe.decoded_text("decoded")).collect()}
    assert (bytes(rows[0].decoded) + bytes(rows[1].decoded)).decode() == "\U0001f3fd"
    assert "�" in rows[0].shown and bytes(rows[2].decoded) == b""


@pytest.mark.parametrize("scale", ["small"])
def test_queries_equal_libraries(spark, small, reference, scale):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for r in QUERIES["op1_byte_bpe"](spark, small).collect():
        ids = reference.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    for r in QUERIES["op8_token_counts"](spark, small).collect():
        n = len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 2048)


def test_counts_equal_library(odd):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {r.doc_id: r.n_tokens for r in tokencount.token_report(odd).collect()}
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(ODD)}


def test_empty_tables(odd):
    none = odd.limit(0)
    assert bytebpe.digests(none).count() == 0 and tokencount.token_report(none).count() == 0
