"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A sentence's log-odds are a fixed background plus weights of its words and their beginnings; a
sentence in which none of them has a weight is clean, so length alone never adds up. A document's
score is the noisy-or of its sentences: one minus the product of their chances to be clean. Weights are learned from document labels through that noisy-or, so they settle on the
sentences that make a document toxic, and those sentences can be pointed out.

Fitted on a bounded sample: at most ``SAMPLE_ROWS`` labelled documents, taken by a hash of the key,
and at most ``FEATURES`` features that speak for the label. Scoring reads every text whole.

Null and empty texts, and those without any evidence, score 0. Repeated rows score alike. Without labels of both kinds all documents score 0. Several labels of one key count
as toxic if one is. Rows with a null key are scored but not learned from.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worldstate.llm.texts import chunks
from worldstate.session import cut_lineage

SAMPLE_ROWS = 8192
FEATURES = 4096
BEGINNINGS = (4, 5, 6, 7, 8)
BACKGROUND = -8.0  # log-odds of a sentence before its evidence counts
SURE = 3.0
STEPS, RATE, DECAY = 400, 0.2, 1e-4
CACHED_WORDS = 400_000

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def features(word: str) -> list[str]:
    """A lower-case word and its beginnings, told apart by a mark."""
    return ["=" + word, *[word[:n] for n in BEGINNINGS if len(word) >= n]]


@dataclass
class Model:
    weights: dict[str, float]
    background: float = BACKGROUND


class Scorer(dict):
    """Words to their features with a weight; one per worker and task."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self[word] = tuple(f for f in features(word) if f in self.model.weights)
        return found

    def speaks(self, text: str) -> bool:
        return any(any(map(self.__getitem__, _WORD.findall(part.lower()))) for part in chunks(text))

    def sentences(self, text: str):
        """``start, end, features`` of each sentence; features are distinct."""
        for match in _SENTENCE.finditer(text):
            yield match.start(), match.end(), {f for w in _WORD.findall(match[0].lower()) for f in self[w]}

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and ``start, end, score`` of sentences at 0.5 or more."""
        if not text or not self.speaks(text):
            return 0.0, []
        clean, offending = 0.0, []
        for start, end, found in self.sentences(text):
            if not found:
                continue
            odds = self.model.background + sum(self.model.weights[f] for f in found)
            clean += math.log1p(math.exp(odds)) if odds < 30 else odds
            if odds >= 0:
                offending.append((start, end, 1 / (1 + math.exp(-odds))))
        return -math.expm1(-clean), offending


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_weights(names: list[str], bags: list[list[list[int]]], toxic: np.ndarray) -> dict[str, float]:
    """Noisy-or maximum likelihood. ``bags``: per document the feature numbers of its sentences with evidence."""
    doc, sentence, feature, n = [], [], [], 0
    for d, bag in enumerate(bags):
        for found in bag:
            doc.append(d)
            sentence += [n] * len(found)
            feature += found
            n += 1
    doc, sentence, feature = np.array(doc, int), np.array(sentence, int), np.array(feature, int)
    weights, mean, square = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
    for step in range(1, STEPS + 1):
        odds = BACKGROUND + np.bincount(sentence, weights[feature], n)
        burden = np.bincount(doc, np.logaddexp(0, odds), len(bags)) + 1e-12
        pull = np.where(toxic, -1 / np.expm1(np.minimum(burden, 500)), 1.0)
        by_sentence = pull[doc] / (1 + np.exp(-odds))
        slope = np.bincount(feature, by_sentence[sentence], len(names)) + DECAY * len(bags) * weights / max(1, len(names))
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        weights -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return dict(zip(names, weights.tolist()))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learns from rows that aren't held out."""
    known = labels.filter(~held_out(F.col(key)) & F.col(key).isNotNull() & F.col(label).isin(0, 1))
    known = known.groupBy(key).agg(F.max(label).cast("int").alias("__toxic"))
    sample = known.orderBy(F.xxhash64(key), key).limit(SAMPLE_ROWS)
    texts = docs.select(F.col(key), F.col(text).alias("__text")).join(F.broadcast(sample), key)
    texts = cut_lineage(texts.select("__text", "__toxic"), "labelled")

    def bags(batches):
        for batch in batches:
            rows = [list({f for w in _WORD.findall((t or "").lower()) for f in features(w)}) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string())), batch.column(1)], ["found", "toxic"])

    spread = texts.mapInArrow(bags, "found array<string>, toxic int").select("toxic", F.explode("found").alias("feature"))
    counted = spread.groupBy("feature").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n")).filter("n >= 3 and bad >= 2")
    totals = texts.agg(F.coalesce(F.sum("__toxic"), F.lit(0)), F.count(F.lit(1))).first()
    bad_docs, good_docs = totals[0], totals[1] - totals[0]
    bad, good = F.col("bad"), F.col("n") - F.col("bad")
    odds = F.log((bad + 0.5) / (bad_docs + 1)) - F.log((good + 0.5) / (good_docs + 1))
    sure = odds / F.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
    chosen = counted.select("feature", sure.alias("sure")).filter(F.col("sure") >= SURE).orderBy(F.desc("sure"), "feature").limit(FEATURES)
    names = sorted(r.feature for r in chosen.collect())
    if not names or not bad_docs or not good_docs:
        return Model({})
    numbers, blank = {name: i for i, name in enumerate(names)}, Model(dict.fromkeys(names, 0.0))

    def speaking(batches):
        scorer = Scorer(blank)
        for batch in batches:
            found = [[sorted(numbers[f] for f in fs) for _, _, fs in scorer.sentences(t or "")] for t in batch.column(0).to_pylist()]
            lists = pa.array([[s for s in bag if s] for bag in found], pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([lists, batch.column(1)], ["bag", "toxic"])

    rows = texts.mapInArrow(speaking, "bag array<array<int>>, toxic int").collect()
    rows.sort(key=lambda r: (r.toxic, r.bag))
    return Model(fit_weights(names, [r.bag for r in rows], np.array([r.toxic == 1 for r in rows])))


def score_texts(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1) and ``offending``: start, end (characters) and score of its sentences at 0.5 or more."""

    @F.arrow_udf("struct<score: double, offending: array<struct<start: int, end: int, score: double>>>")
    def scored(column: pa.Array) -> pa.Array:
        scorer = Scorer(model)
        found = [scorer.score(v.as_py()) for v in column]
        kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
        spans = pa.array([[{"start": s, "end": e, "score": p} for s, e, p in f[1]] for f in found], pa.list_(kind))
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.float64()), spans], ["score", "offending"])

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "offending")]
    found = docs.select(*kept, scored(F.col(text)).alias("__scored"))
    return found.select(*kept, F.col("__scored.score").alias("score"), F.col("__scored.offending").alias("offending"))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: held out or not, score, prediction, and where its worst sentence stands."""
    scored = score_texts(docs.select("doc_id", "text"), train(docs, labels))
    worst = F.array_max(F.transform("offending", lambda s: F.struct(s["score"], (-s["start"]).alias("at"), s["end"].alias("end"))))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("offending").alias("n_offending"), (-worst["at"]).alias("worst_start"), worst["end"].alias("worst_end"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below 0.5, with their own columns."""
    marked = docs.withColumn("__text", F.col("text"))
    scored = score_texts(marked.withColumnsRenamed({c: f"={c}" for c in docs.columns}), train(docs, labels), "__text")
    return scored.filter("score < 0.5").select(*[F.col(f"`={c}`").alias(c) for c in docs.columns])
