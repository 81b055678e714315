"""Rows that share an id, and even the crc32 of their texts, are different rows."""

import zlib

import pytest

from tabweave.llm import jaccard, lines, lm, quality, toxicity


@pytest.fixture(scope="module")
def clash():
    """Two texts of one crc32."""
    seen = {}
    for i in range(2_000_000):
        text = f"alpha w{i} beta gamma x{i * 7919 % 99991} delta\nsecond y{i}"
        old = seen.setdefault(zlib.crc32(text.encode()), text)
        if old != text:
            return old, text
    raise AssertionError("no clash found")


def test_scores(spark, clash):
    one, two = clash
    rows = [(3, one + " alpha alpha"), (8, two + " beta beta")] * 4 + [(7, one), (7, two)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.fit(docs, least_ngram=2)
    got = sorted(r.base_score for r in lm.score(docs, model).where("doc_id = 7").collect())
    alone = [lm.score(docs.where(docs.text == t).where("doc_id = 7"), model).first().base_score for t in clash]
    assert got == pytest.approx(sorted(alone))


def test_lines_and_groups(spark, clash):
    one, two = clash
    docs = spark.createDataFrame([(7, one), (7, two), (9, two)], "doc_id long, text string")
    gone = lines.removed_lines(docs)
    assert {(r.doc_id, r.line_no) for r in gone.collect()} >= {(9, 0), (9, 1)}
    assert {r.crc for r in gone.where("doc_id = 9").collect()}.isdisjoint(
        {r.crc for r in lines.document_lines(docs.limit(1), "doc_id", "text").collect()})
    kept = jaccard.keep_one(docs).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(7, one), (7, two)])


def test_one_id_on_a_third_of_all_rows_does_not_grow_the_fit(spark, monkeypatch):
    rows = [(i, f"good text {i} here, and more.") for i in range(60)] + [(7, f"row {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(60)], "doc_id long, quality int, toxic boolean").selectExpr(
        "doc_id", "quality", "cast(toxic as int) toxic")
    sizes = []
    monkeypatch.setattr(quality, "fit_positive_unlabelled", lambda a, b, *x: sizes.append(len(a) + len(b)) or _plain(a, b, *x))
    model = quality.fit(docs, labels, sample=50)
    assert sizes[0] <= 2 * 4 * 50 and all(0 <= r.score <= 1 for r in quality.score(docs, model).collect())
    monkeypatch.setattr(toxicity, "fit_chain", lambda c, b, y, f, own=toxicity.fit_chain: sizes.append(len(b)) or own(c, b, y, f))
    toxicity.fit(docs, labels, ["toxic"], sample=50)
    assert sizes[1] <= 2 * 50


_plain = quality.fit_positive_unlabelled
