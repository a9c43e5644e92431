"""License scans against a plain search for phrases, and notices with changed words."""

import re

from worldstate.llm import licenses
from worldstate.llm.queries import QUERIES


def plain(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = []
    for phrase, label in licenses.PHRASES.items():
        own = phrase.split()
        places += [(i, label) for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own]
    starts = [i for i, _ in places]
    labels = ",".join(sorted({label for _, label in places}))
    return len(words), len(places), min(starts, default=None), max(starts, default=None), labels


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op10_license_diagonals"](spark, folder).collect()
    check(rows, texts)
    assert any(r.n_base for r in rows) and any(r.labels != r.base_labels for r in rows)


def test_odd_texts(spark):
    texts = [
        None, "", "...", "MIT", "The MIT License!", "mit-license mit\nLICENSE mit license", "cc by cc by", "cc by-sa", "éMIT license", "gnu general public licence",
        "GNU General Public License and the Apache License", "word " * 60_000 + "apache license", "mit license " * 3000, "apache apache license",
    ]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, label string").repartition(3)
    check(licenses.license_report(df).collect(), dict(enumerate(texts)))
    twice = licenses.license_report(df.union(df)).collect()
    assert len(twice) == 2 * len(texts) and {r.n_base for r in twice if r.doc_id == 12} == {3000}
    assert licenses.license_report(df.limit(0)).count() == 0


def test_notices_bear_changes(spark):
    notice = licenses.NOTICES["bsd"][0]
    changed = notice.replace("binary", "compiled").replace("are permitted", "are both permitted")
    half = " ".join(notice.split()[:7])
    rows = spark.createDataFrame([(0, f"start {notice} end"), (1, changed), (2, half), (3, notice[::-1])], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_report(rows).collect()}
    assert [got[i].labels for i in range(4)] == ["bsd", "bsd", "", ""]
    assert got[0].score == 1.0 and licenses.COVER <= got[1].score < 1
    _, found = licenses.scan(rows.filter("doc_id = 0"))
    assert [(r.start, r.end) for r in found.collect()] == [(1, 1 + len(notice.split()))]


def plain_labels(text):
    """Labels by counting, for every template and word, which pairs of words lie where they should."""
    words, found = licenses.words_of(text), set()
    for label, notices in licenses.NOTICES.items():
        for notice in notices:
            own = licenses.words_of(notice)
            places = len(own) - 1
            votes = {}
            for at in range(places):
                for i in range(len(words) - 1):
                    if words[i : i + 2] == own[at : at + 2]:
                        votes.setdefault(i - at, set()).add(at)
            for d, ats in votes.items():
                near = {at: min((abs(e - d), e) for e in votes if abs(e - d) <= licenses.MERGE and at in votes[e])[1] + at
                        for at in range(places) if any(abs(e - d) <= licenses.MERGE and at in votes[e] for e in votes)}
                for span in ([d + at for at in ats], list(near.values())):
                    if len(span) >= licenses.COVER * places and max(span) + 2 - min(span) <= licenses.LONGEST * len(own):
                        found.add(label)
    return found


def test_method_labels_by_brute_force(spark):
    import random

    rng, texts = random.Random(4), ["licensed under licensed under licensed under CC BY-NC 4.0", "Licensed under CC BY NC Licensed under CC BY-NC 4.0"]
    notices = [n for own in licenses.NOTICES.values() for n in own]
    for _ in range(150):
        words = " ".join(rng.choice(notices) for _ in range(rng.randrange(1, 3))).split()
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = rng.choice([[], ["other"], words[at : at + 3], ["x", "y", "z", "u"]])
        texts.append(" ".join(["before"] * rng.randrange(4) + words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: set(filter(None, r.labels.split(","))) - set(filter(None, r.base_labels.split(","))) for r in licenses.license_report(df).collect()}
    base = {i: set(filter(None, plain(t)[4].split(","))) for i, t in enumerate(texts)}
    want = {i: plain_labels(t) - base[i] for i, t in enumerate(texts)}
    assert got == want and got[0] == {"cc-by-nc"} and sum(map(bool, want.values())) > 60 and sum(not w for w in want.values()) > 5
