"""Phrase collocations counted in burst tries whose subtrees are spilled as sorted runs.

A task numbers the words it meets and counts word windows in a trie: one root per language, below it word
numbers, and containers, which are hash tables from the rest of a window to its count. A container that grows
past ``BURST`` windows bursts into a node with one container per next word. When a trie holds ``MOST_WINDOWS``
windows its largest subtrees leave as sorted runs of phrases with counts, until half is left; the rest leaves at
the end. Spark's shuffle merges the runs; what it partitions by is the whole phrase, since one first word may
begin a third of all phrases.

Three scans count words, then pairs, then phrases of three to five words. A phrase of ``least`` occurrences
consists of words and of pairs that occur as often, so a scan skips windows over words or pairs known to be
rarer. What is known is a bitmap of hashed phrases of fixed size (``BITS``), the only thing sent to all tasks; a
clash of hashes lets a rare phrase be counted in vain and loses none. Counts are exact and cover all texts.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line breaks and these into words at blanks and
tabs. A null text is empty, a null language is ``und``. Texts of any length are read whole. Columns other than the
two named are ignored. An empty table gives no rows. Equal rows count as often as they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worldstate.session import cut_lineage

LONGEST = 5
LEAST = 100
FIRST = 2000
NO_LANGUAGE = "und"
BURST = 4096
MOST_WINDOWS = 800_000
MOST_WORDS = 600_000
SLICE = 1 << 19
BITS = 1 << 24
SALTS = 64
BREAK, BLANK = -1, -2  # numbers of what is no word: the end of a piece, and nothing between two blanks

_TABLE = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
_PART = 1 << 20


def word_tokens(text: str) -> Iterator[list[bytes]]:
    """Lower-case words, with a line feed where a piece ends and empty strings, in lists of bounded length."""
    data = text.encode("utf-8", "surrogatepass").lower().translate(_TABLE)
    start = 0
    while start < len(data):
        end = len(data) if len(data) - start <= _PART else data.find(b" ", start + _PART)
        end = len(data) if end < 0 else end
        yield data[start:end].replace(b"\n", b" \n ").split(b" ")
        start = end


class Words(dict):
    """Numbers of words in the order met; words that ``known`` denies are breaks."""

    def __init__(self, known=None):
        super().__init__({b"\n": BREAK, b"": BLANK})
        self.known, self.words = known, []

    def __missing__(self, word: bytes) -> int:
        if self.known is not None and not self.known(word):
            self[word] = BREAK
            return BREAK
        number = self[word] = len(self.words)
        self.words.append(word)
        return number

    def forget_denied(self) -> None:
        for word in [w for w, number in self.items() if number == BREAK and w != b"\n"]:
            del self[word]

    def numbers(self, text: str) -> np.ndarray:
        """The text's word numbers, ``BREAK`` between pieces and at the end."""
        parts = [np.fromiter(map(self.__getitem__, part), np.int32, len(part)) for part in word_tokens(text)]
        whole = np.concatenate([*parts, np.array([BREAK], np.int32)])
        return whole[whole != BLANK]


class Trie:
    """Counts of windows (rows of word numbers, padded with -1 behind): nodes by word above hash containers."""

    def __init__(self, burst: int = BURST):
        self.burst, self.children, self.size = burst, {}, 0

    def add(self, windows: np.ndarray, counts: np.ndarray) -> None:
        rests = np.ascontiguousarray(windows[:, 1:], "<i4").view(f"V{4 * windows.shape[1] - 4}").ravel().tolist()
        children, insert, new = self.children, self._insert, 0
        fits = self.burst if windows.shape[1] > 2 else 1 << 62  # a node of pairs would hold single counts
        for first, rest, count in zip(windows[:, 0].tolist(), rests, counts.tolist()):
            is_container, held = children.get(first) or (False, None)
            if not is_container:
                insert(children, first, rest, count)
            elif rest in held:
                held[rest] += count
            elif len(held) < fits:
                held[rest] = count
                new += 1
            else:
                insert(children, first, rest, count)
        self.size += new

    def _insert(self, children: dict, word: int, rest: bytes, count: int) -> None:
        while True:
            below = children.get(word)
            if below is None:
                children[word] = (True, {rest: count})
                self.size += 1
                return
            is_container, held = below
            if is_container:
                seen = held.get(rest)
                held[rest] = count if seen is None else seen + count
                if seen is None:
                    self.size += 1
                    if len(held) > self.burst and len(rest) > 4:
                        children[word] = (False, self._burst(held))
                return
            children, word, rest = held, int.from_bytes(rest[:4], "little", signed=True), rest[4:]

    @staticmethod
    def _burst(held: dict) -> dict:
        children: dict = {}
        for rest, count in held.items():
            word = int.from_bytes(rest[:4], "little", signed=True)
            children.setdefault(word, (True, {}))[1][rest[4:]] = count
        return children

    @classmethod
    def _held(cls, below: tuple) -> int:
        is_container, held = below
        return len(held) if is_container else sum(map(cls._held, held.values()))

    @classmethod
    def _windows(cls, below: tuple, prefix: bytes, data: list, counts: list) -> None:
        is_container, held = below
        if is_container:
            data += [prefix + rest for rest in held]
            counts += held.values()
        else:
            for word, deeper in held.items():
                cls._windows(deeper, prefix + word.to_bytes(4, "little", signed=True), data, counts)

    def spill(self, keep: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Takes out subtrees, largest first, until ``keep`` windows are left; each as sorted windows with counts."""
        sizes = sorted(((self._held(below), word) for word, below in self.children.items()), reverse=True)
        waiting_data, waiting_counts = [], []
        for n, word in sizes:
            if self.size <= keep:
                break
            self._windows(self.children.pop(word), word.to_bytes(4, "little", signed=True), waiting_data, waiting_counts)
            self.size -= n
            if len(waiting_data) >= 1 << 16:
                yield self._sorted(waiting_data, waiting_counts, width)
                waiting_data, waiting_counts = [], []
        if waiting_data:
            yield self._sorted(waiting_data, waiting_counts, width)

    @staticmethod
    def _sorted(data: list, counts: list, width: int) -> tuple[np.ndarray, np.ndarray]:
        windows = np.frombuffer(b"".join(data), "<i4").reshape(-1, width)
        order = np.lexsort(windows.T[::-1])
        return windows[order], np.array(counts, np.int64)[order]


def prefix_counts(windows: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct first ``length`` words of sorted windows, whole ones only, and their sums."""
    whole = windows[:, length - 1] >= 0
    heads, counts = windows[whole, :length], counts[whole]
    if not len(heads):
        return heads, counts
    first = np.flatnonzero(np.append(True, (heads[1:] != heads[:-1]).any(axis=1)))
    return heads[first], np.add.reduceat(counts, first)


def _summed(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and how often each stands."""
    if windows.shape[1] == 2:
        keys, counts = np.unique(windows[:, 0].astype(np.int64) << 32 | windows[:, 1], return_counts=True)
        return np.stack([keys >> 32, keys & 0xFFFFFFFF], axis=1).astype(np.int32), counts
    order = np.lexsort(windows.T[::-1])
    return prefix_rows(windows[order])


def prefix_rows(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.append(True, (ordered[1:] != ordered[:-1]).any(axis=1)))
    return ordered[first], np.diff(np.append(first, len(ordered)))


_ODD, _WHOLE = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def _mixed(state, word):
    """One more word's hash in the state; for numbers below 2^64 and for arrays of uint64 alike."""
    state = state ^ state >> (np.uint64(29) if isinstance(state, np.ndarray) else 29)
    return state * np.uint64(_ODD) + word if isinstance(word, np.ndarray) else (state * _ODD + word) & _WHOLE


def _language(language: str) -> int:
    return _mixed(0, _hash(language.encode()))


class Known:
    """A bitmap of hashed phrases, a power of two of bits: denies only phrases that are not in it."""

    def __init__(self, bitmap: bytes):
        self.bitmap, self.flags = bitmap, np.frombuffer(bitmap, np.uint8)
        self.shift = 65 - (8 * len(bitmap)).bit_length()

    def word(self, language: int, word: int) -> bool:
        place = _mixed(language, word) >> self.shift
        return bool(self.bitmap[place >> 3] >> (place & 7) & 1)

    def pairs(self, language: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        place = _mixed(_mixed(np.full(len(first), language, np.uint64), first), second) >> np.uint64(self.shift)
        return (self.flags[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class Counter:
    """Counts the windows of one language in a task; ``share`` languages divide the task's bounds."""

    def __init__(self, language: str, shortest: int, longest: int, words: Known | None, pairs: Known | None):
        self.language, self.shortest, self.longest, self.hashed = language, shortest, longest, _language(language)
        self.words_known, self.pairs_known, self.share = words, pairs, 1
        self._restart()

    def _restart(self) -> None:
        known = self.words_known
        self.words = Words(known and (lambda word: known.word(self.hashed, _hash(word))))
        self.trie, self.singles, self.hashes = Trie(), np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def take(self, texts: list[str]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for text in texts:
            waiting.append(self.words.numbers(text))
            n += len(waiting[-1])
            if n >= SLICE:
                yield from self._count(np.concatenate(waiting))
                waiting, n = [], 0
        if waiting:
            yield from self._count(np.concatenate(waiting))

    def _count(self, numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.longest == 1:
            found = np.bincount(numbers[numbers >= 0], minlength=len(self.words.words))
            found[: len(self.singles)] += self.singles
            self.singles = found
            if len(self.words) > MOST_WORDS // self.share:
                yield from self.rest()
            return
        for at in range(0, len(numbers), SLICE):
            part = numbers[at : at + SLICE + self.longest - 1]
            windows = self._windows(part, min(SLICE, len(numbers) - at))
            if len(windows):
                self.trie.add(*_summed(windows))
            if self.trie.size > MOST_WINDOWS // self.share:
                yield from self._runs(MOST_WINDOWS // self.share // 2)
        if len(self.words) > MOST_WORDS // self.share:
            self.words.forget_denied()
            if len(self.words) > MOST_WORDS // self.share // 2:
                yield from self.rest()

    def _windows(self, part: np.ndarray, starts: int) -> np.ndarray:
        """The longest window at each start, of frequent words and pairs, if it is long enough."""
        ahead = np.append(part, np.full(self.longest - 1, BREAK, np.int32))
        linked = (ahead[:-1] >= 0) & (ahead[1:] >= 0)
        if self.pairs_known is not None:
            new = self.words.words[len(self.hashes) :]
            self.hashes = np.append(self.hashes, np.fromiter(map(_hash, new), np.uint64, len(new)))
            at = np.flatnonzero(linked)
            linked[at] = self.pairs_known.pairs(self.hashed, self.hashes[ahead[at]], self.hashes[ahead[at + 1]])
        length = np.ones(starts, np.int64)
        going = np.ones(starts, bool)
        for k in range(self.longest - 1):
            going &= linked[k : k + starts]
            length += going
        rows = np.flatnonzero(length >= self.shortest)
        windows = np.stack([ahead[rows + k] for k in range(self.longest)], axis=1)
        windows[np.arange(self.longest)[None, :] >= length[rows, None]] = -1
        return windows

    def _runs(self, keep: int) -> Iterator[pa.RecordBatch]:
        first = np.array([*self.words.words, None], object)
        behind = np.array([*(b" " + w for w in self.words.words), None], object)
        for windows, counts in self.trie.spill(keep, self.longest):
            for length in range(self.shortest, self.longest + 1):
                heads, sums = prefix_counts(windows, counts, length)
                if len(heads):
                    yield self._batch(reduce(add, (behind[heads[:, k]] for k in range(1, length)), first[heads[:, 0]]), sums, length)

    def _batch(self, phrases: list, counts: np.ndarray, length: int) -> pa.RecordBatch:
        columns = [pa.repeat(pa.scalar(self.language), len(phrases)), pa.array(phrases, pa.binary()), pa.repeat(pa.scalar(length, pa.int32()), len(phrases)), pa.array(counts, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "words", "n"])

    def rest(self) -> Iterator[pa.RecordBatch]:
        """All that is still held; then the numbers of words begin anew."""
        if self.longest == 1:
            met = np.flatnonzero(self.singles)
            words = self.words.words
            for at in range(0, len(met), 1 << 16):
                part = met[at : at + (1 << 16)]
                yield self._batch([words[i] for i in part.tolist()], self.singles[part], 1)
            yield self._batch([None], np.array([self.singles.sum()]), 1)
        else:
            yield from self._runs(0)
        self._restart()


def _counted(docs: DataFrame, shortest: int, longest: int, least: int, words: Known | None = None, pairs: Known | None = None) -> DataFrame:
    """``lang, phrase, words, f`` of phrases with ``least`` occurrences; for single words also the sum, as phrase null."""

    def runs(batches):
        counters: dict[str, Counter] = {}
        for batch in batches:
            texts: dict[str, list[str]] = {}
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts.setdefault(language, []).append(text)
            for language, own in texts.items():
                if language not in counters:
                    counters[language] = Counter(language, shortest, longest, words, pairs)
                    for counter in counters.values():
                        counter.share = len(counters)
                yield from counters[language].take(own)
        for counter in counters.values():
            yield from counter.rest()

    found = docs.mapInArrow(runs, "lang string, phrase binary, words int, n long")
    summed = found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("f"))
    return cut_lineage(summed.filter((F.col("f") >= least) | F.col("phrase").isNull()), f"phrases{longest}")


def _known(counts: DataFrame, bits: int) -> Known:
    """The bitmap of a table of phrases: ``bits`` bits, whatever the number of phrases."""
    chunk = min(bits, 1 << 16)

    shift = 65 - bits.bit_length()

    @F.arrow_udf("long")
    def place(language: pa.Array, phrase: pa.Array) -> pa.Array:
        both = zip(language.to_pylist(), phrase.to_pylist())
        return pa.array([reduce(_mixed, map(_hash, b.split(b" ")), _language(a)) >> shift for a, b in both], pa.int64())

    def marked(table: pa.Table) -> pa.Table:
        flags = np.zeros(chunk, np.uint8)
        flags[table["place"].to_numpy() % chunk] = 1
        return pa.table({"chunk": table["chunk"][:1], "flags": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    places = counts.filter("phrase is not null").select(place("lang", "phrase").alias("place")).distinct()
    chunks = places.withColumn("chunk", F.expr(f"place div {chunk}")).groupBy("chunk").applyInArrow(marked, "chunk long, flags binary")
    bitmap = np.zeros(bits // 8, np.uint8)
    for number, flags in chunks.collect():
        bitmap[number * chunk // 8 : (number + 1) * chunk // 8] = np.frombuffer(flags, np.uint8)
    return Known(bitmap.tobytes())


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, bits: int = BITS) -> DataFrame:
    """``lang, phrase, words, f``: phrases of 1 to ``longest`` words (``longest`` is 2 or more) that occur ``least`` times.

    One more row per language, with phrase null, has the number of all its words.
    """
    own = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    levels = [_counted(own, 1, 1, least)]
    words = _known(levels[0], bits)
    levels.append(_counted(own, 2, 2, least, words))
    if longest > 2:
        levels.append(_counted(own, 3, longest, least, words, _known(levels[1], bits)))
    return reduce(DataFrame.unionByName, levels).withColumn("phrase", F.col("phrase").cast("string"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, most: int = FIRST, bits: int = BITS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``most`` phrases of each language.

    A cut of a phrase into first words and rest scores floor(1000 * a * n / (l * r)); its lowest cut counts, the
    first of equals. Phrases inside a longer one that occurs as often are left out: a phrase inside a longer one
    is also inside one that is longer by one word, so only these are looked at.
    """
    counts = phrase_counts(docs, text, lang, longest, least, bits)
    totals = counts.filter("phrase is null").select("lang", F.col("f").alias("n"))
    counts = counts.filter("phrase is not null")
    longer = counts.filter("words > 2").withColumn("w", F.split("phrase", " "))

    def joined(first: Column, n: Column) -> Column:
        return F.array_join(F.slice("w", first, n), " ")

    inside = longer.select("lang", "f", F.explode(F.array(joined(F.lit(1), F.col("words") - 1), joined(F.lit(2), F.col("words") - 1))).alias("phrase")).distinct()
    candidates = counts.filter("words > 1").join(inside, ["lang", "phrase", "f"], "left_anti").withColumn("w", F.split("phrase", " "))
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), "words", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    whole = {c: f"cast({c} as decimal(19, 0))" for c in "alrn"}
    score = F.expr(f"({whole['a']} * {whole['n']} * 1000) div ({whole['l']} * {whole['r']})")  # 38 digits, exact
    scored = cuts.join(totals, "lang").withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    best = best.select("lang", "phrase", "a", "n", "b.l", "b.r", "b.score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    salted = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    salted = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= most)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


COLLOCATION_SQL = rf"""
with pieces as (
  select coalesce(lang, '{NO_LANGUAGE}') as lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
listed as (select lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') as w from pieces),
totals as (select lang, cast(sum(len(w)) as bigint) as n from listed group by lang),
grams as (
  select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase
  from listed, (select unnest(range(1, {LONGEST + 1})) as k) ks where len(w) >= k),
counts as (select lang, k, phrase, count(*) as f from grams group by all having count(*) >= {LEAST}),
split as (select lang, k, phrase, f, string_split(phrase, ' ') as w from counts where k > 1),
inside as (
  select lang, f, array_to_string(w[1:k - 1], ' ') as phrase from split union select lang, f, array_to_string(w[2:k], ' ') from split),
cuts as (
  select s.lang, s.phrase, s.f as a, c.at, s.k, array_to_string(s.w[1:c.at], ' ') as head, array_to_string(s.w[c.at + 1:s.k], ' ') as tail
  from split s join (select unnest(range(1, {LONGEST})) as at) c on c.at < s.k
  where not exists (select 1 from inside i where i.lang = s.lang and i.phrase = s.phrase and i.f = s.f)),
scored as (
  select c.lang, c.phrase, c.a, c.at, x.f as l, y.f as r, t.n,
    cast((cast(1000 as hugeint) * c.a * t.n) // (cast(x.f as hugeint) * y.f) as bigint) as score
  from cuts c join counts x on x.lang = c.lang and x.phrase = c.head join counts y on y.lang = c.lang and y.phrase = c.tail
  join totals t on t.lang = c.lang
  qualify row_number() over (partition by c.lang, c.phrase order by score, c.at) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from scored qualify rank <= {FIRST}
"""
