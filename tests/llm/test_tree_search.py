from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spokeworks.llm import tree_search as ts

SCHEMA = "vec_id LONG, embedding ARRAY<FLOAT>, leaf INT, score DOUBLE"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0.0) for i, v in rows], SCHEMA)


def brute(rows, k, every=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % every == 0:
            scores = x @ q
            order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def result(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("block", [2048, 37])
def test_recall_and_scores(spark, monkeypatch, block):
    monkeypatch.setattr(ts, "BLOCK", block)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16)) * 2
    rows = [(i, (centres[i % 30] + rng.normal(size=16)).tolist()) for i in range(2500)]
    got = result(ts.search(table(spark, rows), F.col("vec_id") % 20 == 0, 20).collect())
    want = brute(rows, 20)
    assert got.keys() == want.keys()
    found = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(found) >= 0.9
    truth = {(q, i): s for q, own in brute(rows, 2500).items() for i, s in own}
    for q, own in got.items():
        assert len(own) == 20
        assert [s for _, s in own] == pytest.approx([truth[q, i] for i, _ in own], abs=1e-9)


def test_fewer_candidates_ties_and_equal_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(15)]
    got = result(ts.search(table(spark, rows), F.col("vec_id") % 20 == 0, 20).collect())
    assert got == {0: [(i, 1.0) for i in range(1, 15)]}
    many = [(i, [1.0, 0.0]) for i in range(800)]
    got = result(ts.search(table(spark, many), F.col("vec_id") == 40, 20).collect())
    assert [i for i, _ in got[40]] == list(range(20))


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0])]
    rows += [(7, [float("inf"), 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, None), (1, [2.0, 1.0])]
    got = result(ts.search(table(spark, rows), F.col("vec_id") % 20 == 0, 20).collect())
    assert got == {0: [(1, 4.0)]}
    assert ts.search(table(spark, rows), F.col("vec_id") == 99, 3).count() == 0
    empty = ts.search(table(spark, rows).limit(0), F.col("vec_id") == 0)
    assert empty.count() == 0 and empty.columns == ["query_id", "rank", "vec_id", "score"]


def test_a_tree_covers_its_sample():
    rng = np.random.default_rng(2)
    sample = rng.normal(size=(3000, 8))
    tree = ts.fit(sample, 100)
    leaf = tree.assign(sample)
    assert 0 <= leaf.min() and leaf.max() < tree.leaves <= 100
    assert sorted(tree.order(sample[0], tree.leaves)) == list(range(tree.leaves))
    assert len(tree.order(sample[0], 7)) == 7
    near = np.mean([leaf[i] in tree.order(v, 5) for i, v in enumerate(sample[:300])])
    assert near > 0.9  # a vector's own leaf comes early
    flat = ts.fit(np.ones((500, 3)), 10)
    assert flat.leaves == 1
