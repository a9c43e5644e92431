"""License scans by diagonal voting.

Every run of ``k`` words of a text has a rolling hash with its position. All hashes are joined in
Spark with the positions of the templates; a match votes for the diagonal (text position minus
template position) it lies on. Each diagonal is verified alone and together with those within a few words
of it, so inserted or missing words don't break a find: for each place of the template the vote on the
nearest diagonal counts, and the span of these votes is kept if it covers enough of the template and isn't much
longer. Of spans on neighbouring diagonals the best stays. Phrases are templates too, but need every
vote on one diagonal. Hashes have 64 bits, so equal hashes stand for equal words. Texts are cut into words and
hashed once; words are counted apart, by Spark.

Words: A-Z lower-cased, maximal runs of digits, letters a-z and characters beyond ASCII. Null is
like empty text: no words, no labels, score 0. Repeated rows are told apart by key and text, and
get the same result. Texts of any length are read whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worldstate.session import cut_lineage

GRAM = 2
MERGE = 3
COVER = 0.8
LONGEST = 1.5
BATCH_ROWS = 512
BROADCAST_ROWS = 100_000  # template positions; more are joined by shuffle

# The phrases of the contract and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Sentences of public license notices, as they stand in files, and the labels they add.
NOTICES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        "See the License for the specific language governing permissions and limitations under the License",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "either version 3 of the License, or (at your option) any later version",
    ],
    "gpl-2.0": ["either version 2 of the License, or (at your option) any later version"],
    "gpl-notice": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
        "You should have received a copy of the GNU General Public License along with this program",
    ],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"],
    "agpl": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
}

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same before letters are lowered


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().lower())


class Hashes(dict):
    """Words to 64-bit hashes, kept while a batch lasts."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def rolling(words: list[bytes], k: int, hashes: Hashes) -> np.ndarray:
    """A hash for each run of ``k`` words."""
    own = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(own) - k + 1
    if n <= 0:
        return np.empty(0, np.int64)
    mixed = np.zeros(n, np.uint64)
    for i in range(k):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + own[i : i + n]
    return (mixed ^ (mixed >> np.uint64(31))).view(np.int64)


def template_table(spark: SparkSession, phrases: dict[str, str], notices: dict[str, list[str]], k: int) -> DataFrame:
    """``hash, template, label, at, places, words, exact``: each run of ``k`` words of each template."""
    rows, hashes = [], Hashes()
    listed = [(text, label, True) for text, label in phrases.items()]
    listed += [(text, label, False) for label, texts in notices.items() for text in texts]
    for number, (text, label, exact) in enumerate(listed):
        words = words_of(text)
        runs = rolling(words, k, hashes).tolist()
        rows += [(h, number, label, at, len(runs), len(words), exact) for at, h in enumerate(runs)]
    made = spark.createDataFrame(rows, "hash long, template int, label string, at int, places int, words int, exact boolean")
    return F.broadcast(made) if len(rows) <= BROADCAST_ROWS else made


def _with_runs(docs: DataFrame, text: str, k: int) -> DataFrame:
    """``docs`` without the text but with ``__runs`` (hashes in text order)."""
    kept = [c for c in docs.columns if c != text]
    extra = [T.StructField("__runs", T.ArrayType(T.LongType()))]

    def made(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part, hashes = batch.slice(at, BATCH_ROWS), Hashes()
                words = [words_of(t) for t in part.column(text).to_pylist()]
                runs = [rolling(w, k, hashes) for w in words]
                ends = np.cumsum([0, *map(len, runs)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, np.int64), *runs]))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], lists], [*kept, "__runs"])

    schema = T.StructType([*docs.select(*[f"`{c}`" for c in kept]).schema.fields, *extra])
    return docs.mapInArrow(made, schema)


def diagonals(runs: DataFrame, templates: DataFrame) -> DataFrame:
    """Votes per ``__row``, template and diagonal; repeated rows don't vote twice."""
    spread = runs.select("__row", F.posexplode("__runs").alias("pos", "hash"))
    voted = spread.join(templates, "hash").withColumn("diagonal", F.col("pos") - F.col("at"))
    keys = ["__row", "template", "label", "places", "words", "exact", "diagonal"]
    return voted.groupBy(*keys).agg(F.collect_set("at").alias("ats"))


def spans(votes: DataFrame) -> DataFrame:
    """``__row, label, exact, start, end, score``: verified places of phrases and notices (word numbers)."""
    phrases = votes.filter("exact and size(ats) = places").select(
        "__row", "label", "exact", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("words")).alias("end"), F.lit(1.0).alias("score")
    )
    near = Window.partitionBy("__row", "template").orderBy("diagonal").rangeBetween(-MERGE, MERGE)
    notices = votes.filter("not exact").withColumn("around", F.collect_list(F.struct("diagonal", "ats")).over(near))

    def nearest(at: Column) -> Column:
        """Word at which the template's place stands, on the nearest diagonal that has it (the lower of two)."""
        having = F.filter("around", lambda d: F.array_contains(d["ats"], at))
        apart = F.transform(having, lambda d: F.struct(F.abs(d["diagonal"] - F.col("diagonal")), d["diagonal"].alias("d")))
        return F.array_min(apart)["d"] + at

    together = F.filter(F.transform(F.sequence(F.lit(0), F.col("places") - 1), nearest), lambda x: x.isNotNull())
    alone = F.transform("ats", lambda at: F.col("diagonal") + at)
    tries = notices.withColumn("words_at", F.explode(F.array(alone, together)))
    tries = tries.withColumns(
        {"start": F.array_min("words_at"), "end": F.array_max("words_at") + GRAM, "cover": F.size("words_at") / F.col("places")}
    )
    kept = tries.filter((F.col("cover") >= COVER) & (F.col("end") - F.col("start") <= LONGEST * F.col("words")))
    # the best of a neighbourhood: most covered, then shortest, then first
    rank = F.struct("cover", (F.col("start") - F.col("end")).alias("short"), (-F.col("start")).alias("first"))
    best = kept.withColumn("rank", rank).withColumn("best", F.max("rank").over(near)).filter("rank = best")
    return phrases.union(best.select("__row", "label", F.lit(False), "start", "end", "cover").distinct())


def scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text",
    phrases: dict[str, str] | None = None, notices: dict[str, list[str]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """All rows as ``__row, key, __words``, and the verified spans by ``__row``."""
    row = F.md5(F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("none")), F.coalesce(F.col(text), F.lit(""))).cast("binary"))
    named = docs.select(F.col(key), F.col(text).alias("__text"), row.alias("__row"))
    counted = F.coalesce(F.regexp_count(F.col("__text"), F.lit(_ANY_CASE)), F.lit(0)).cast("long")
    templates = template_table(docs.sparkSession, PHRASES if phrases is None else phrases, NOTICES if notices is None else notices, GRAM)
    votes = cut_lineage(diagonals(_with_runs(named.select("__row", "__text"), "__text", GRAM), templates), "votes")
    return named.select("__row", key, counted.alias("__words")), spans(votes)


def license_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: words, places of base phrases, base labels, all labels and a score (1 for a
    phrase or a whole notice, else the largest share of a notice that was found)."""
    rows, found = scan(docs, key, text)
    base = F.col("exact")
    facts = found.groupBy("__row").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    )
    joined = rows.join(facts, "__row", "left")
    return joined.select(
        key, F.col("__words").alias("n_words"), F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
