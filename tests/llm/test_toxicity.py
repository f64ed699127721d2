from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from words import ODD, words

from spokeworks.llm import toxicity as tx


def maximal_by_definition(scores):
    """Segments of a recursive definition: the best segment, then both sides of it."""
    values = [-tx.DRIFT if s is None else s for s in scores]
    out = []

    def go(lo, hi):
        best = max(
            ((round(sum(values[a:b]), 9), -(b - a), -a, a, b) for a, b in itertools.combinations(range(lo, hi + 1), 2)),
            default=None,
        )
        if best is None or best[0] <= 0:
            return
        _, _, _, a, b = best
        go(lo, a)
        out.append((a, b, best[0]))
        go(b, hi)

    go(0, len(values))
    return out


def test_segments_are_the_maximal_ones():
    rng = random.Random(4)
    for _ in range(300):
        scores = [rng.choice([None, None, None, rng.uniform(-2, 2), rng.uniform(0, 3)]) for _ in range(rng.randint(0, 14))]
        got = tx.maximal_segments(scores)
        want = maximal_by_definition(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


INSULTS = "blarg snorf grutz".split()


def corpus(rng, n):
    pool = words(rng, 400)
    out = []
    for i in range(n):
        own = rng.choices(pool, k=rng.randint(20, 120))
        toxic = int(i % 6 == 0)
        if toxic:
            for _ in range(rng.randint(3, 6)):
                own.insert(rng.randrange(len(own)), rng.choice(INSULTS))
        out.append((i, " ".join(own), toxic))
    return out


def test_held_out_toxic_texts_are_found(spark):
    rng = random.Random(9)
    rows = corpus(rng, 600)
    model = tx.train(spark.createDataFrame(rows[:400], "doc_id LONG, text STRING, toxic INT"))
    assert all(model.scores[w] > 0 for w in INSULTS)
    got = {r["doc_id"]: r for r in tx.score(spark.createDataFrame(rows[400:], "doc_id LONG, text STRING, toxic INT"), model).collect()}
    truth = {i: t for i, _, t in rows[400:]}
    assert sum(got[i]["predicted"] == t for i, t in truth.items()) >= 0.97 * len(truth)
    found = next(r for i, r in got.items() if truth[i] and r["predicted"])
    own = rows[found["doc_id"]][1].split()
    assert any(w in INSULTS for s in found["segments"] for w in own[s["start"] : s["end"]])
    kept = tx.without_toxic(spark.createDataFrame(rows[400:], "doc_id LONG, text STRING, toxic INT"), model)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}


def test_odd_rows(spark, documents):
    learn = spark.createDataFrame(
        [("blarg x", 1), ("y z", 0), (None, 1), ("w", None), ("v", 7)], "text STRING, toxic INT"
    )
    for model in (tx.train(learn), tx.train(learn.limit(0)), tx.train(learn.where("toxic = 0"))):
        df = documents(*[(i % 3 or None, t) for i, t in enumerate(ODD)], extra="score segments")
        got = tx.score(df, model).collect()
        assert len(got) == len(ODD)
        assert all(0 <= r["score"] <= 1 for r in got)
        assert tx.score(df.limit(0), model).count() == 0
        assert tx.without_toxic(df, model).columns == df.columns


def test_labels_join_by_either_way(spark, documents, monkeypatch):
    docs = documents((1, "a"), (2, "b"), (2, "c"), (None, "d"))
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (2, 1, 0), (None, 1, 1), (9, 1, 1)], "doc_id LONG, quality INT, toxic INT")
    for bound in (100, 0):
        monkeypatch.setattr(tx, "KNOWN_LABELS", bound)
        got = sorted((r["text"], r["toxic"]) for r in tx.learn_rows(docs, labels).collect())
        assert got == [("a", 1), ("b", 0), ("c", 0)]


def test_extreme_values_and_the_curve():
    rng = np.random.default_rng(1)
    n, decay, factor = 500, 1.3, 0.02
    best = (np.log(factor * n) - np.log(rng.exponential(size=20000))) / decay
    assert tx.extreme_factor([(n, float(x)) for x in best], decay) == pytest.approx(factor, rel=0.05)
    x = rng.normal(size=5000)
    y = (rng.random(5000) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(float)
    weight, offset = tx.logistic(x, y)
    assert (weight, offset) == (pytest.approx(2, abs=0.2), pytest.approx(-1, abs=0.2))
