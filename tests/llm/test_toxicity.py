"""Held-out accuracy of the toxicity classifier, and awkward rows."""

import numpy as np

from lynceus.llm import toxicity


def auc(s, y):
    a, b = s[y == 1], s[y == 0]
    return ((a[:, None] > b[None, :]).mean() + (a[:, None] == b[None, :]).mean() / 2)


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = {r.doc_id: r for r in toxicity.op5(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    own = [(got[r.doc_id].score, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    assert auc(np.array([s for s, _ in own]), np.array([y for _, y in own])) > 0.9


def test_awkward_rows(spark):
    rows = [(1, "you idiot", "x"), (1, "you idiot", "x"), (2, None, "x"), (None, "", "x"), (3, "word " * 50000, "x"), (4, "fine \x00 text", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Score string")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (3, 0), (4, 0)], "doc_id long, toxic int")
    for own in (labels, labels.limit(0)):
        got = toxicity.score(docs, toxicity.learn(docs, own)).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(docs.limit(0), toxicity.learn(docs.limit(0), labels)).collect() == []


def test_correlated_voters_share_weight():
    """Copies of one voter count little more than the voter."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 2000)
    noisy = lambda p: np.where(rng.random(2000) < p, y, 1 - y)
    good, bad = [noisy(0.8) for _ in range(3)], noisy(0.6)
    votes = np.stack(good + [bad] * 8, axis=1)
    q = toxicity.posterior(votes, noisy(0.7))
    assert ((q > 0.5) == y).mean() > 0.82
