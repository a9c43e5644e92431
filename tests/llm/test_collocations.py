"""Collocations against plain counting with dictionaries."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from worldstate.llm import collocations as C

SCHEMA = "text string, lang string, phrase string, f long, n long, words int"


def plain(rows, least, most, longest=5):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n, found = totals[lang], []
        often = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        for p, a in often.items():
            longer = (q for q, b in often.items() if len(q) > len(p) and 100 * b >= 100 * a)
            if any(q[i : i + len(p)] == p for q in longer for i in range(len(q) - len(p) + 1)):
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:most]):
            out.append((lang, rank + 1, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def made(seed, rows=60):
    rng = random.Random(seed)
    words = ["a", "The", "THE", "of", "é", "ß", "x-y", " ", "w\x00", "(in", "kayak"]
    texts = []
    for _ in range(rows):
        parts = [rng.choice([*words, "new york city hall", "a of a of"]) + rng.choice([" ", "  ", "\t", ". ", "\n", ",", " "]) for _ in range(rng.randrange(60))]
        texts.append(("".join(parts), rng.choice(["en", "en", "de", None, ""])))
    return texts


def found(spark, rows, least, most=2000, **limits):
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA).repartition(3)
    got = C.collocations(df, least=least, most=most, **limits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("least,most,bits", [(2, 2000, 1 << 16), (3, 7, 64)])
def test_plain_counting(spark, least, most, bits):
    rows = [*made(least), (None, None), ("", "en"), (None, "fr"), *[("the same row again, the same row again", "en")] * 5]
    want = plain(rows, least, most)
    assert len(want) > 10 and found(spark, rows, least, most, bits=bits) == want


def test_long_text_and_empty_table(spark):
    text = "one two three four five six, " * 90_000  # over two megabytes: read in parts
    assert found(spark, [(text, "en")], 100) == plain([(text, "en")], 100, 2000)
    assert found(spark, [], 2) == []


def test_parts_of_long_texts():
    text = ("word " * 50 + "x" * 30 + ".") * 20_000
    whole = [w for part in C.word_tokens(text) for w in part if w]
    assert whole == [w for w in text.encode().replace(b".", b" \n ").split(b" ") if w]


@pytest.mark.parametrize("width", [2, 5])
def test_trie_spills_whole_subtrees_and_loses_nothing(width):
    rng = np.random.default_rng(width)
    windows = rng.integers(0, 12, (20_000, width)).astype(np.int32) * (rng.random((20_000, 1)) < 0.9)
    if width > 2:
        windows[::7, 3:] = -1
    trie, want, got, bursts = C.Trie(burst=50), Counter(map(tuple, windows.tolist())), Counter(), 0

    def take(run, counts):
        assert (np.lexsort(run.T[::-1]) == np.arange(len(run))).all()
        for row, n in zip(run.tolist(), counts.tolist()):
            got[tuple(row)] += n
        return set(run[:, 0].tolist())

    for part in np.array_split(windows, 9):
        trie.add(*C._summed(part))
        bursts += sum(not is_container for is_container, _ in trie.children.values())
        if trie.size > 600:
            firsts = set().union(*(take(*run) for run in trie.spill(300, width)))
            assert trie.size <= 300 and not firsts & set(trie.children)
    assert bursts > 0 or width == 2
    for run in trie.spill(0, width):
        take(*run)
    assert got == want and trie.size == 0


def test_prefix_sums():
    windows = np.array([[1, 2, 3], [1, 2, 4], [1, 2, -1], [1, 3, -1], [2, 2, 2]], np.int32)
    windows = windows[np.lexsort(windows.T[::-1])]
    counts = np.arange(1, 6)
    heads, sums = C.prefix_counts(windows, counts, 2)
    assert heads.tolist() == [[1, 2], [1, 3], [2, 2]] and sums.tolist() == [6, 4, 5]
    assert C.prefix_counts(windows, counts, 3)[0].tolist() == [[1, 2, 3], [1, 2, 4], [2, 2, 2]]


def test_spills_inside_tasks(spark, monkeypatch):
    counter, merged = C.Counter("en", 3, 5, None, None), Counter()
    monkeypatch.setattr(C, "MOST_WINDOWS", 200)
    monkeypatch.setattr(C, "MOST_WORDS", 9)
    texts = [t for t, _ in made(9, 120)]
    batches = [b for i in range(0, 120, 7) for b in counter.take(texts[i : i + 7])] + list(counter.rest())
    for b in batches:
        for phrase, n in zip(b.column("phrase").to_pylist(), b.column("n").to_pylist()):
            merged[phrase.decode()] += n
    want = Counter()
    for text in texts:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            want.update(" ".join(words[i : i + k]) for k in (3, 4, 5) for i in range(len(words) - k + 1))
    assert merged == want and len(batches) > 3
