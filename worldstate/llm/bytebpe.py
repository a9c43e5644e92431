"""Byte-level BPE encoding and decoding with a public rank file.

The ``tokenizers`` library gets the ranks as a BPE model over the byte-to-character table. Texts
are cut by the pattern; what a worker has not met lately goes through the library, and its ids are
laid out for all occurrences. Offsets follow from the characters that begin in each token. Decoding reverses the byte table, so
any list of ids gives back its bytes, also when characters are split between tokens.

Null and empty texts have no tokens. Texts of any length are handled in parts cut before white
space; nothing is cut off. Repeated rows are encoded like any other. A column that bears an
output's name is replaced; all other columns stay.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, models, pre_tokenizers

from worldstate.llm.texts import blank_parts, chunks

RANKS = "byte_bpe_50k.tiktoken"
CACHED_PARTS = 250_000
BATCH_ROWS = 256


@lru_cache
def byte_table() -> dict[int, str]:
    """Byte to character: visible Latin-1 characters stand for themselves, the rest for 256, 257, …"""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return {b: chr(b if b in visible else next(hidden)) for b in range(256)}


def _mapped(token: bytes) -> str:
    table = byte_table()
    return "".join(table[b] for b in token)


@lru_cache
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a rank file (base64 and number per line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _halves(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two tokens that merge into ``token`` last; None when lower ranks don't lead there."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best, at = min((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best >= rank:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


class Codec:
    """Encoder and decoder for one rank file; one per worker process."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        vocab = {_mapped(token): rank for token, rank in ranks.items()}
        merges = []
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            if len(token) > 1 and (pair := _halves(token, rank, ranks)):
                merges.append((_mapped(pair[0]), _mapped(pair[1])))
        self.library = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)
        self.pattern = regex.compile(pattern)
        self.token_bytes = _token_bytes(path)
        size = max(self.token_bytes) + 1
        self.opened = np.zeros(size, np.int32)  # characters that begin in a token
        self.inside = np.zeros(size, np.int32)  # 1: it begins inside a character
        for rank, token in self.token_bytes.items():
            self.opened[rank] = sum(b & 0xC0 != 0x80 for b in token)
            self.inside[rank] = token[0] & 0xC0 == 0x80
        self.known: dict[str, bytes] = {}

    def _coded(self, parts: list[str]) -> list[bytes]:
        """The ids of each part, as int32 bytes, from one library call."""
        pieces = [self.pattern.findall(part) for part in parts]
        found = self.library.encode(list(chain.from_iterable(pieces)), is_pretokenized=True, add_special_tokens=False)
        word = np.array(found.word_ids, np.int64)
        ids = np.array(found.ids, np.int32).tobytes()
        ends = (4 * np.searchsorted(word, np.cumsum([len(p) for p in pieces]))).tolist()
        return [ids[i:j] for i, j in zip(chain([0], ends), ends)]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        own = []
        for chunk in chunks(text):
            first, *parts = blank_parts(chunk)
            missing = list(set(parts).difference(self.known))
            if len(self.known) + len(missing) > CACHED_PARTS:
                self.known, missing = {}, list(set(parts))
            head, *rest = self._coded([first, *[" " + part for part in missing]])
            self.known.update(zip(missing, rest))
            own += [head, *map(self.known.__getitem__, parts)]
        return np.frombuffer(b"".join(own), np.int32)

    def starts(self, ids: np.ndarray) -> np.ndarray:
        """For each id the index of the character that it begins in."""
        opened = self.opened[ids]
        return np.cumsum(opened, dtype=np.int32) - opened - self.inside[ids]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


@lru_cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, np.int32), *parts]))


def _arrays(own: Codec, texts: list[str | None], outputs: tuple[str, ...]) -> dict[str, pa.Array]:
    found = [own.encode(text or "") for text in texts]
    made = {"ids": lambda: _lists(found), "starts": lambda: _lists([own.starts(f) for f in found])}
    made["decoded"] = lambda: pa.array([own.decode(f.tolist()) for f in found], pa.binary())
    return {name: made[name]() for name in outputs}


KINDS = {"ids": T.ArrayType(T.IntegerType()), "starts": T.ArrayType(T.IntegerType()), "decoded": T.BinaryType()}


def encode(
    docs: DataFrame, text: str = "text", outputs: tuple[str, ...] = ("ids", "starts"),
    path: str | None = None, pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """Adds ``ids`` (token ids), ``starts`` (character index each token begins in) and, if asked
    for, ``decoded`` (the bytes decoded from the ids again).

    Tokens that share a character have the same start. Null text gives empty lists. Results leave
    the worker in small batches, so memory follows the longest text, not the partition.
    """
    path = path or public_tokenizers.path(RANKS)
    kept = [c for c in docs.columns if c not in outputs]
    schema = T.StructType([*docs.select(*[f"`{c}`" for c in kept]).schema.fields, *[T.StructField(o, KINDS[o]) for o in outputs]])

    def coded(batches):
        own = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                made = _arrays(own, part.column(text).to_pylist(), outputs)
                columns = {c: part.column(c) for c in kept} | made
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(coded, schema)


@lru_cache
def _token_bytes(path: str) -> dict[int, bytes]:
    """Id to bytes, by the reversed byte table over the vocabulary's texts."""
    back = {c: b for b, c in byte_table().items()}
    return {rank: bytes(back[c] for c in _mapped(token)) for token, rank in read_ranks(path).items()}


def decode(docs: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """Adds ``out``, the bytes that the ids stand for; null ids give no bytes.

    A list cut inside a character gives that character's bytes on either side; joined again they
    are whole. An id outside the vocabulary is an error.
    """
    path = path or public_tokenizers.path(RANKS)

    @F.arrow_udf("binary")
    def decoded(column: pa.Array) -> pa.Array:
        get = _token_bytes(path).__getitem__
        return pa.array([b"".join(map(get, value.as_py() or [])) for value in column], pa.binary())

    return docs.withColumn(out, decoded(F.col(ids)))


def decoded_text(column):
    """Bytes as text; bytes of characters that were split at either end become U+FFFD each run."""

    @F.arrow_udf("string")
    def shown(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else v.decode("utf-8", errors="replace") for v in values.to_pylist()], pa.string())

    return shown(column)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: number of tokens, digests of its ids and of the bytes decoded from them."""
    coded = encode(docs.select(F.col(key), F.col(text)), text, ("ids", "decoded"))
    return coded.select(
        F.col(key),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
