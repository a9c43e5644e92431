"""Token counts by heap-and-linked-list byte-pair merging, without emitting ids.

A word's symbols stand in a linked list; a heap gives the adjacent pair of lowest rank, leftmost
first, until none can merge. The count is the number of initial symbols minus the number of
merges. Words repeat, so each worker keeps counts of the words it has met (bounded).

Null and empty texts count 0 tokens. Texts of any length are read whole, in parts cut before
white space. A column that bears an output's name is replaced; all other columns stay.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from worldstate.llm.bytebpe import byte_table
from worldstate.llm.texts import chunks

VOCABULARY = "word_bpe_49k.json"
CACHED_WORDS = 800_000
# other characters' case, classes or composition may differ between Unicode versions
_UNSURE = regex.compile("[^\x00-\x1b -\u02ff]")


class Counts(dict):
    """Words between white space to numbers of tokens; a missing one is merged and kept."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.library = Tokenizer.from_file(path)
        self.symbol = [vocab[c] for _, c in sorted(byte_table().items())]
        self.last = [vocab[c + self.end] for _, c in sorted(byte_table().items())]
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        self.ranks = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.merged_ids = [vocab[a + b] for a, b in pairs]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True))))
        self.back = {c: b for b, c in byte_table().items()}

    def __missing__(self, run: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        words = self.pattern.findall(run)
        count = self[run] = self.merged(run.encode()) if words == [run] else sum(map(self.__getitem__, words))
        return count

    def merged(self, word: bytes) -> int:
        rank_of, new_of = self.ranks.get, self.merged_ids
        ids = [self.symbol[b] for b in word]
        ids[-1] = self.last[word[-1]]
        n = count = len(ids)
        heap = [rank << 32 | i for i, pair in enumerate(zip(ids, ids[1:])) if (rank := rank_of(pair)) is not None]
        heapq.heapify(heap)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            rank, i = divmod(heapq.heappop(heap), 1 << 32)
            j = right[i]
            # the pair may be gone: its left or right symbol has merged meanwhile
            if j == n or rank_of((ids[i], ids[j])) != rank:
                continue
            new = ids[i] = new_of[rank]
            ids[j] = -1
            count -= 1
            after = right[i] = right[j]
            if after < n:
                left[after] = i
                if (found := rank_of((new, ids[after]))) is not None:
                    heapq.heappush(heap, found << 32 | i)
            before = left[i]
            if before >= 0 and (found := rank_of((ids[before], new))) is not None:
                heapq.heappush(heap, found << 32 | before)
        return count

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        total = 0
        for part in chunks(text):
            if _UNSURE.search(part) is None:
                words = part.lower().split()
            else:  # the library's own case and letter tables
                shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                words = [bytes(map(self.back.__getitem__, word)).decode() for word, _ in shown]
            total += sum(map(self.__getitem__, words))
        return total

    def text(self, text: str) -> int:
        """Tokens of a text; each special string inside it is one."""
        if "<|" not in text:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


@lru_cache
def counts(path: str) -> Counts:
    return Counts(path)


def count_tokens(docs: DataFrame, text: str = "text", out: str = "n_tokens", path: str | None = None) -> DataFrame:
    """Adds ``out``: the number of tokens of each text (0 for null)."""
    path = path or public_tokenizers.path(VOCABULARY)

    @F.arrow_udf("long")
    def counted(column: pa.Array) -> pa.Array:
        own = counts(path)
        return pa.array(np.fromiter((own.text(value.as_py() or "") for value in column), np.int64, len(column)))

    return docs.withColumn(out, counted(F.col(text)))


def token_report(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """One row per document: bytes, tokens, and whether it holds more than ``limit`` tokens."""
    found = count_tokens(docs.select(F.col(key), F.col(text)), text, "n_tokens")
    return found.select(
        F.col(key),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
