"""Token ids in files of canonical, length-limited Huffman codes.

A folder holds a ``codebook`` (id and code length, of the ids that occur) and ``blocks``. Lengths come from the
counts of all ids by package-merge and are ``LONGEST`` bits at most (more only where so many ids need it); codes
are numbered by length, then id. A block is one row: the keys and sizes of consecutive documents and their codes
one after another, first bit highest, with the bit at which every ``EVERY``-th id begins. Blocks share nothing but
the codebook, so any of them is read alone; the checkpoints of many blocks are decoded side by side, one table
look-up per id. Files and the blocks in them follow the ascending order of keys (null first); rows that repeat a
key follow one another in any order.

Ids are kept as little-endian numbers of two or four bytes until they are coded. A block holds whole documents of
``BLOCK_IDS`` ids together, or one longer document. Only the counts pass through the driver: one per id of the
vocabulary, which may have ``MOST_IDS`` ids.

Null and empty texts have no ids but the end. Texts are read whole. Columns other than the two named are ignored.
An empty table gives files without blocks, which read as no rows.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from worldstate.llm.bytebpe import byte_table
from worldstate.llm.texts import chunks
from worldstate.session import fresh_dir

VOCABULARY = "word_bpe_49k.json"
END = 2
LONGEST = 20
BLOCK_IDS = 1 << 16
EVERY = 256
MOST_IDS = 1 << 22
FILE_IDS = 1 << 24
CACHED_RUNS = 400_000
GROUP_IDS = 1 << 21
# what Python and the library may split or lower differently; such parts go to the library as they are
_UNSURE = regex.compile("[^\x00-\x1b -\u02ff]|<\\|")


class RunIds(dict):
    """Ids of the words between white space, each found by the library once; a bounded number is kept.

    When the number is reached a new generation begins; what it meets again moves over from the one before.
    """

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.shown = byte_table()
        self.before: dict[str, list[int]] = {}
        self._begin()

    def _begin(self) -> None:
        self.ids, self.ends = array("I"), array("q", [0])

    def renew(self) -> None:
        ids, ends = self.ids, self.ends
        self.before = {run: ids[ends[at] : ends[at + 1]] for run, at in self.items()}
        self.clear()
        self._begin()

    def _keep(self, ids) -> int:
        self.ids.extend(ids)
        self.ends.append(len(self.ids))
        return len(self.ends) - 2

    def __missing__(self, run: str) -> int:
        ids = self.before.get(run)
        if ids is None:
            if run.isalpha():
                ids = self._word(run)
            elif run[:-1].isalpha() and run[-1] in ".,;:!?":
                ids = self._known(run[:-1]) + self._known(run[-1])
            else:
                words = self.pattern.findall(run)
                ids = self._word(run) if words == [run] else sum(map(self._known, words), array("I"))
        found = self[run] = self._keep(ids)
        return found

    def _word(self, word: str) -> list[int]:
        shown = word if word.isascii() else "".join(map(self.shown.__getitem__, word.encode()))
        return [token.id for token in self.library.model.tokenize(shown)]

    def _known(self, word: str) -> array:
        at = self[word]
        return self.ids[self.ends[at] : self.ends[at + 1]]

    def numbers(self, text: str) -> list[np.ndarray]:
        """Numbers of kept lists of ids, whose ids one after another are those of the text."""
        found = []
        for part in chunks(text):
            if _UNSURE.search(part) is None:
                runs = part.lower().split()
                found.append(np.fromiter(map(self.__getitem__, runs), np.int64, len(runs)))
            else:
                found.append(np.array([self._keep(self.library.encode(part, add_special_tokens=False).ids)]))
        return found

    def batch(self, texts: list[str | None], end: int) -> list[np.ndarray]:
        """Ids of each text with the end id."""
        if len(self.ends) > CACHED_RUNS:
            self.renew()
        last = np.array([self._keep([end])])
        parts = [[*self.numbers(text or ""), last] for text in texts]
        numbers = np.concatenate([p for own in parts for p in own])
        edges = np.frombuffer(self.ends, np.int64).copy()  # an array that is looked at cannot grow
        lengths = edges[numbers + 1] - edges[numbers]
        after = np.cumsum(lengths)
        places = np.repeat(edges[numbers] - after + lengths, lengths) + np.arange(after[-1])
        ids = np.frombuffer(self.ids, np.uint32)[places]
        cuts = after[np.cumsum([sum(map(len, own)) for own in parts]) - 1]
        return np.split(ids, cuts[:-1])


@lru_cache
def _runs(path: str) -> RunIds:
    return RunIds(path)


def text_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", end: int = END, path: str | None = None) -> DataFrame:
    """``key, ids``: the library's ids of each whole text and the end id, as numbers of 2 bytes where all ids fit, else 4."""
    path = path or public_tokenizers.path(VOCABULARY)
    width = 2 if max(end, Tokenizer.from_file(path).get_vocab_size() - 1) < 1 << 16 else 4

    @F.arrow_udf("binary")
    def coded(column: pa.Array) -> pa.Array:
        own, texts, out = _runs(path), column.to_pylist(), []
        for at in range(0, len(texts), 512):
            out += [ids.astype(f"<u{width}").tobytes() for ids in own.batch(texts[at : at + 512], end)]
        return pa.array(out, pa.binary())

    return docs.select(F.col(key).alias("key"), coded(F.col(text)).alias("ids")).withColumn("width", F.lit(width))


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Code length of each id (0 where it never occurs), by package-merge."""
    lengths = np.zeros(len(counts), np.uint8)
    present = np.flatnonzero(counts)
    if len(present) < 2:
        lengths[present] = 1
        return lengths
    order = present[np.argsort(counts[present], kind="stable")]
    weights, n = counts[order].astype(object if counts.sum() > 1 << 40 else np.int64), len(order)
    longest = max(longest, int(n - 1).bit_length())
    singles, packages = [], weights[:0]
    for _ in range(longest):
        both = np.concatenate([weights, packages])
        rank = np.argsort(both, kind="stable")
        singles.append(np.cumsum(rank < n))
        merged = both[rank]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    taken = 2 * (n - 1)
    for counted in reversed(singles):
        own = int(counted[taken - 1]) if taken else 0
        lengths[order[:own]] += 1
        taken = 2 * (taken - own)
    return lengths


class Codebook:
    """Canonical codes of given lengths, and the table that reads them."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        own = lengths[order].astype(np.int64)
        self.bits = int(own.max(initial=1))
        spans = np.left_shift(1, self.bits - own)
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (np.cumsum(spans) - spans) >> (self.bits - own)
        self._order, self._spans = order, spans

    @property
    def table(self) -> np.ndarray:
        """For every ``bits`` bits the id whose code they begin with, times 64, plus the code's length."""
        entries = np.repeat(self._order.astype(np.int64) << 6 | self.lengths[self._order], self._spans)
        return np.append(entries, np.zeros((1 << self.bits) - len(entries), np.int64))

    def pack(self, ids: np.ndarray, every: int = EVERY) -> tuple[bytes, np.ndarray]:
        """The codes of ``ids``, and the bit at which each ``every``-th one begins."""
        length = self.lengths[ids].astype(np.int64)
        after = np.cumsum(length)
        starts = after - length
        word, bit = starts >> 5, starts & 31
        codes = self.codes[ids] << (64 - bit - length).astype(np.uint64)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        out = np.zeros(int(after[-1] >> 5) + 2, np.uint64)
        out[word[first]] = np.add.reduceat(codes >> np.uint64(32), first)
        out[word[first] + 1] += np.add.reduceat(codes & np.uint64(0xFFFFFFFF), first)
        return out.astype(">u4").tobytes()[: int(after[-1] + 7) >> 3], starts[::every]

    def unpack(self, payloads: list[bytes], checkpoints: list[np.ndarray], sizes: list[int], table: np.ndarray, every: int = EVERY) -> np.ndarray:
        """The ids of several blocks one after another; all their checkpoints advance side by side."""
        data = np.frombuffer(b"".join(payloads) + bytes(8), np.uint8)
        windows = np.ndarray((len(data) - 3,), ">u4", data, strides=(1,))
        shift = 8 * (np.cumsum([0, *map(len, payloads)])[:-1])
        at = np.concatenate([np.asarray(c, np.int64) + s for c, s in zip(checkpoints, shift)])
        left = np.concatenate([np.minimum(every, n - np.arange(0, n, every)) for n in sizes])
        places = np.cumsum(left) - left
        out = np.empty(int(left.sum()), np.int64)
        lanes = np.argsort(-left, kind="stable")
        at, places, left = at[lanes], places[lanes], left[lanes]
        drop = np.uint32(32 - self.bits)
        for step in range(int(left[0]) if len(left) else 0):
            going = np.searchsorted(-left, -step)  # lanes that still have an id
            own = at[:going]
            entry = table[(windows[own >> 3].astype(np.uint32) << (own & 7).astype(np.uint32)) >> drop]
            out[places[:going] + step] = entry >> 6
            own += entry & 63
        return out


BLOCK = "part int, start long, n long, keys array<long>, sizes array<long>, checkpoints binary, payload binary"


def write_ids(ids: DataFrame, path: str, longest: int = LONGEST) -> None:
    """Writes ``key (long), ids (binary), width`` as a folder of codebook and blocks."""
    spark = ids.sparkSession
    coded_once = fresh_dir(spark, "ids")
    ids.withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(coded_once)
    ids = spark.read.parquet(coded_once)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for own in _id_groups(batch):
                found = np.bincount(own, minlength=len(total))
                found[: len(total)] += total
                total = found
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["id", "n"])

    counts = ids.select("ids", "width").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = counts.limit(MOST_IDS + 1).toArrow()
    if found.num_rows > MOST_IDS:
        raise ValueError(f"more than {MOST_IDS} different ids")
    weights = np.zeros(int(max(found["id"].to_numpy(), default=-1)) + 1, np.int64)
    weights[found["id"].to_numpy()] = found["n"].to_numpy()
    lengths = code_lengths(weights, longest)
    used = np.flatnonzero(lengths)
    spark.createDataFrame(pa.table({"id": used, "bits": lengths[used].astype(np.int32)})).coalesce(1).write.parquet(f"{path}/codebook")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, start, keys, waiting, n = Codebook(lengths), 0, [], [], 0

        def block() -> pa.RecordBatch:
            payload, checkpoints = book.pack(np.concatenate(waiting))
            row = {"part": part, "start": start, "n": n, "keys": keys, "sizes": list(map(len, waiting)), "checkpoints": checkpoints.astype("<u8").tobytes(), "payload": payload}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for part, key, width, value in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "width")), batch.column("ids")):
                own = np.frombuffer(value.as_buffer(), f"<u{width}")
                if waiting and n + len(own) > BLOCK_IDS:
                    yield block()
                    start, keys, waiting, n = start + n, [], [], 0
                keys.append(key)
                waiting.append(own.astype(np.uint32))
                n += len(own)
        if waiting:
            yield block()

    schema = pa.schema([("part", pa.int32()), ("start", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("checkpoints", pa.binary()), ("payload", pa.binary())])
    files = max(spark.sparkContext.defaultParallelism, -(-int(weights.sum()) // FILE_IDS))
    ordered = ids.repartitionByRange(files, F.asc_nulls_first("key"), "row").sortWithinPartitions(F.asc_nulls_first("key"), "row")
    blocks = ordered.select(F.spark_partition_id().alias("part"), "key", "width", "ids").mapInArrow(coded, BLOCK)
    blocks.write.option("compression", "none").option("parquet.block.size", 16 << 20).parquet(f"{path}/blocks")


def _id_groups(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Ids of a batch in a few arrays."""
    widths, waiting, size = batch.column("width").to_numpy(), [], 0
    for width, value in zip(widths.tolist(), batch.column("ids")):
        waiting.append(np.frombuffer(value.as_buffer(), f"<u{width}"))
        size += len(waiting[-1])
        if size > GROUP_IDS:
            yield np.concatenate(waiting).astype(np.int64)
            waiting, size = [], 0
    if waiting:
        yield np.concatenate(waiting).astype(np.int64)


def _decoded(spark: SparkSession, path: str, schema: str, column: str, shown: Callable[[np.ndarray], object], kind: pa.DataType) -> DataFrame:
    book = spark.read.parquet(f"{path}/codebook").limit(MOST_IDS).toArrow()
    lengths = np.zeros(int(max(book["id"].to_numpy(), default=-1)) + 1, np.uint8)
    lengths[book["id"].to_numpy()] = book["bits"].to_numpy()

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(lengths)
        table = book.table
        for batch in batches:
            rows, at = batch.column("n").to_numpy(), 0
            while at < len(rows):
                end = at + max(1, int(np.searchsorted(np.cumsum(rows[at:]), GROUP_IDS, side="right")))
                yield from group(batch.slice(at, end - at), book, table)
                at = end

    def group(blocks: pa.RecordBatch, book: Codebook, table: np.ndarray) -> Iterator[pa.RecordBatch]:
        payloads = [v.as_buffer() for v in blocks.column("payload")]
        checkpoints = [np.frombuffer(v.as_buffer(), "<u8") for v in blocks.column("checkpoints")]
        ids = book.unpack(payloads, checkpoints, blocks.column("n").to_pylist(), table)
        sizes = blocks.column("sizes")
        per = np.diff(sizes.offsets.to_numpy())
        own = sizes.flatten().to_numpy()
        after = np.cumsum(own)
        before = np.repeat(np.cumsum(blocks.column("n").to_numpy()) - blocks.column("n").to_numpy(), per)
        start = after - own - before + np.repeat(blocks.column("start").to_numpy(), per)
        values = [shown(ids[a - n : a]) for a, n in zip(after.tolist(), own.tolist())]
        part = np.repeat(blocks.column("part").to_numpy(), per)
        columns = [pa.array(part, pa.int32()), blocks.column("keys").flatten(), pa.array(start), pa.array(own), pa.array(values, kind)]
        yield pa.RecordBatch.from_arrays(columns, ["part", "key", "start", "n_ids", column])

    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    found = blocks.mapInArrow(documents, f"part int, key long, start long, n_ids long, {column} {schema}")
    # one number per file: where it begins among all ids
    files = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    first = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("part", F.coalesce(first, F.lit(0)).alias("before"))
    return found.join(files, "part").select("key", (F.col("start") + F.col("before")).alias("start"), "n_ids", column)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``key, start, n_ids, ids``: each document's ids and the number of ids of all documents before it."""
    return _decoded(spark, path, "array<long>", "ids", lambda ids: ids, pa.list_(pa.int64()))


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """``key, start, n_ids, crc32``: as ``read_ids``, with the CRC-32 of the ids as little-endian 32-bit numbers."""
    return _decoded(spark, path, "long", "crc32", lambda ids: zlib.crc32(ids.astype("<u4")), pa.int64())


def id_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes all texts, writes their files to the shared folder and reads these back."""
    path = fresh_dir(docs.sparkSession, "token-ids")
    write_ids(text_ids(docs, key, text), path)
    found = read_checksums(docs.sparkSession, path)
    return found.select(F.col("key").alias(key), "start", F.col("n_ids").alias("n_tokens"), F.col("crc32").alias("ids_crc32"))
