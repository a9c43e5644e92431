"""The pipeline's stages against plain versions of each, on their own inputs."""

import hashlib
import re
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_duplicates import components
from worldstate.llm import bytebpe, linededup
from worldstate.session import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, small):
    docs, found = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = cut_lineage(stage(spark, docs, small), name)
        found.append((docs, out))
        docs = out
    return found


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(steps):
    assert all(out.columns == COLUMNS for _, out in steps[:-1]) and steps[-1][1].columns == [*COLUMNS, "ids", "starts", "decoded_sha256"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "mix_sources", "byte_bpe"]


def test_toxicity_keeps_clean_rows(spark, small, steps):
    before, after = map(rows, steps[0])
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    gone = set(before) - set(after)
    assert all(after[i] == before[i] for i in after)
    assert not [i for i in gone if labels.get(i) == 0]


def test_line_dedup(steps):
    before, after = map(rows, steps[1])
    sites, seen = Counter(r.source for r in before.values()), Counter()
    for r in before.values():
        for line in {x.strip(" ") for x in r.text.split("\n")} - {""}:
            seen[r.source, line] += 1
    for i, r in before.items():
        kept = [x for x in r.text.split("\n") if not (seen[r.source, x.strip(" ")] >= linededup.MIN_PAGES and seen[r.source, x.strip(" ")] > linededup.RATIO * sites[r.source])]
        assert (after[i].text, after[i].n_chars) == ("\n".join(kept), len("\n".join(kept)))
    assert set(before) == set(after)


def five_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_near_dedup(steps):
    before, after = map(rows, steps[2])
    ids = sorted(before)
    sets = [five_words(before[i].text) for i in ids]
    alike = [(a, b) for a in range(len(ids)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    root = components(len(ids), alike)
    assert alike and set(after) == {ids[r] for r in root} and all(after[i] == before[i] for i in after)


def test_mix_keeps_rows_in_files_of_mixed_order(spark, steps):
    before, after = steps[3]
    assert rows(before) == rows(after)
    at = F.struct(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("n"))
    sources = [r.source for r in sorted(after.select("source", at.alias("at")).collect(), key=lambda r: (r["at"].file, r["at"].n))]
    shares = Counter(sources)
    first = Counter(sources[: len(sources) // 2])
    assert all(abs(first[s] - n / 2) <= 8 for s, n in shares.items())


def test_encoded(steps):
    before, after = steps[4]
    ranks = bytebpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(list(r.ids) == library.encode_ordinary(r.text) for r in after.collect())
    assert all(r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in after.collect())
    assert after.count() == before.count()


def test_odd_rows(spark, small):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, slot string, ids string, shard int"
    odd = [(1, None, None, None, None, 0.1, "x", "y", 3), (None, "a b", "en", "s", 3, None, None, None, None), (2, "", "en", "s", 0, 0.2, "x", "y", 1), (2, "", "en", "s", 0, 0.2, "x", "y", 1), (4, "word " * 30_000, "en", "s", 150_000, 0.0, "", "", 0)]
    for data in (odd, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = cut_lineage(stage(spark, docs, small), name)
            assert docs.columns == columns if name != "byte_bpe" else set(docs.columns) == {*columns, "starts", "decoded_sha256"}
        got = docs.collect()
        assert sorted((r.doc_id or 0 for r in got)) == ([0, 1, 4] if data else [])


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0
