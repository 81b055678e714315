"""Quality and toxicity models: gradients, edge cases, held-out accuracy."""

import numpy as np
import pytest

from tabweave.llm import linear, quality, toxicity
from tabweave.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_positive_unlabelled_risk_finds_the_share():
    """Positives around 1, negatives around -1, unlabelled a mixture."""
    r = np.random.default_rng(0)
    positive = r.normal(1, 0.5, (2000, 1))
    mixture = np.where(r.random(4000) < 0.7, r.normal(1, 0.5, 4000), r.normal(-1, 0.5, 4000))[:, None]
    w = linear.fit_positive_unlabelled(positive, mixture, 0.7)
    p = linear.sigmoid(mixture @ w[:-1] + w[-1])
    assert abs((p > 0.5).mean() - 0.7) < 0.05
    w = linear.fit_positive_unlabelled(np.zeros((0, 1)), mixture, 0.7)
    assert w[0] == 0 and linear.sigmoid(w[-1]) == pytest.approx(0.7)


def test_logistic():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 2))
    y = (r.random(3000) < linear.sigmoid(2 * x[:, 0] - 1)).astype(float)
    w = linear.fit_logistic(x, y, steps=600)
    assert w == pytest.approx([2, 0, -1], abs=0.25)
    assert linear.fit_logistic(x, np.zeros(3000))[:-1] == pytest.approx(0)


def accuracy(spark, name, label, folder=FOLDER, predicted="predicted"):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = QUERIES[name](spark, folder).join(labels, "doc_id").where("held_out").collect()
    y, p = np.array([r[label] for r in rows]), np.array([r[predicted] for r in rows])
    return (p[y == 1] == 1).mean(), (p[y == 0] == 0).mean()


def test_quality_on_held_out_documents(spark):
    kept, dropped = accuracy(spark, "op5_quality_classifier", "quality")
    assert kept > 0.95 and dropped > 0.8


def test_toxicity_on_held_out_documents(spark):
    # the small tables label some thirty toxic documents, too few to learn the words
    caught, spared = accuracy(spark, "op10_toxicity", "toxic", "/root/testdata/sf0.1")
    assert caught > 0.9 and spared > 0.99


ODD = [(None, "text here", "x"), (1, None, None), (1, None, None), (2, "", "y"), (3, "a " * 50_000, "z"), (4, "ä" * 9, None)]


def test_edge_cases(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, None), (1, 1, 1), (2, None, 0), (None, 1, 1), (3, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality.keep_good(docs, model, 0.0).columns == docs.columns
    assert quality.keep_good(docs, model, 0.0).count() == len(ODD)
    assert quality.keep_good(docs, model, 1.1).count() == 0
    chain = toxicity.fit(docs, labels.selectExpr("doc_id", "1 - quality junk", "toxic"), ["junk", "toxic"])
    assert len(toxicity.score(docs, chain).collect()) == len(ODD)
    nothing = docs.limit(0)
    assert quality.score(nothing, quality.fit(nothing, labels.limit(0))).count() == 0
    assert toxicity.score(nothing, toxicity.fit(nothing, labels.limit(0), ["quality", "toxic"])).count() == 0
    unlabelled = quality.score(docs, quality.fit(docs, labels.limit(0))).collect()
    assert {r.score for r in unlabelled} == {0.5}


def test_chain_feeds_earlier_categories():
    """The second category copies the first, which only part of the features show."""
    r = np.random.default_rng(1)
    y = (r.random((2000, 1)) < 0.4).astype(float).repeat(2, axis=1)
    buckets = [np.array([7] if a else [8]) if r.random() < 0.9 else np.array([9]) for a in y[:, 0]]
    chain = toxicity.fit_chain(["first", "second"], buckets, y, r.integers(0, 3, 2000))
    assert chain.buckets.tolist() == [7, 8, 9] or set(chain.buckets) <= {7, 8, 9}
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1 and chain.weights[1][-2] > 0.5
