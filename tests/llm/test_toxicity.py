"""Held-out accuracy, located sentences and odd rows."""

import zlib

import pytest

from worldstate.llm import toxicity
from worldstate.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"
CLEAN = "the quick brown fox sees a lazy dog. it walks on. nothing happens here"


@pytest.fixture(scope="module")
def scored(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = QUERIES["op6_noisy_or_toxicity"](spark, FOLDER).collect()
    return rows, [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]


def test_held_out_accuracy(spark, scored):
    rows, mine = scored
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(p == y for p, y in mine) / len(mine) >= 0.98
    assert all(0 <= r.worst_start < r.worst_end <= len(texts[r.doc_id]) for r in rows if r.n_offending)


def test_held_out_recall(scored):
    """86 of 97 here; most missed are junk (one word repeated, other words in capitals) without an offending word. README has the figures of the larger tables."""
    found = [p for p, y in scored[1] if y]
    assert sum(found) / len(found) >= 0.85


def table(spark):
    rows = [(i, CLEAN + f". word{i} it went. " + ("you vile oaf, go away. end" if i % 4 == 0 else "end"), "clash") for i in range(120)]
    odd = [(200, None), (201, ""), (202, "..!?\n\n"), (203, "YOU VILE OAF, GO AWAY"), (204, "calm text. " * 30_000), (205, "calm. " * 30_000 + "the vile oaf. calm"), (None, "vile oaf")]
    rows += [(i, t, "clash") for i, t in odd] + rows[:1]
    return spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)


def labels(spark, n=120):
    return spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(n)] + [(None, 0, 1)], "doc_id long, quality int, toxic int")


def test_sentences_are_located(spark):
    docs = table(spark)
    model = toxicity.train(docs, labels(spark))
    assert model.weights == toxicity.train(docs, labels(spark)).weights
    got = {r.doc_id: r for r in toxicity.score_texts(docs, model).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    assert [got[i].score for i in (200, 201, 202)] == [0.0, 0.0, 0.0]
    assert got[204].score < 0.5 <= got[205].score and got[None].score >= 0.5
    assert [text[205][s.start : s.end] for s in got[205].offending] == [" the vile oaf"]
    for i in range(120):
        assert (got[i].score >= 0.5) == (i % 4 == 0)
        assert [text[i][s.start : s.end] for s in got[i].offending] == [" you vile oaf, go away"] * (i % 4 == 0)


def test_stage_keeps_columns_and_clean_rows(spark):
    docs = table(spark)
    kept = toxicity.drop_toxic(docs, labels(spark))
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} == {"clash"}
    assert sorted(r.doc_id for r in kept.collect()) == [*[i for i in range(120) if i % 4], 200, 201, 202, 204]


def test_without_labels_or_rows(spark):
    docs = table(spark)
    none = toxicity.toxicity_report(docs, labels(spark, 0))
    assert none.count() == docs.count() and none.agg({"predicted": "max"}).first()[0] == 0
    assert toxicity.toxicity_report(docs.limit(0), labels(spark)).count() == 0
