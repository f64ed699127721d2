from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spokeworks.llm import exact_search as es

SCHEMA = "vec_id LONG, embedding ARRAY<DOUBLE>, rank INT, q_block STRING, part STRING, long STRING"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x") for i, v in rows], SCHEMA)


def brute(rows, k, every=100):
    out = []
    whole = [(i, [int(np.floor(x * 1024)) for x in v]) for i, v in rows]
    for i, q in {(i, tuple(v)) for i, v in whole if i % every == 0}:
        scores = {(sum(x * y for x, y in zip(q, v, strict=True)), j) for j, v in whole if j != i}
        for s, j in sorted(scores, key=lambda x: (-x[0], x[1]))[:k]:
            out.append((i, j, s))
    return sorted(out)


def result(rows):
    last = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        n, score, vec = last.get(r["query_id"], (0, None, None))
        assert r["rank"] == n + 1 and (score is None or (-score, vec) < (-r["score"], r["vec_id"]))
        last[r["query_id"]] = (r["rank"], r["score"], r["vec_id"])
    return sorted((r["query_id"], r["vec_id"], r["score"]) for r in rows)


@pytest.mark.parametrize("block, growth", [(2048, 8), (31, 2)])
def test_against_brute_force(spark, monkeypatch, block, growth):
    monkeypatch.setattr(es, "BLOCK", block)
    monkeypatch.setattr(es, "BLOCKS_PER_PART", 2)
    monkeypatch.setattr(es, "GROWTH", growth)
    rng = np.random.default_rng(1)
    axes = rng.normal(size=(4, 12))
    x = rng.normal(size=(700, 4)) @ axes * rng.gamma(2, 1, size=(700, 1)) + rng.normal(size=(700, 12)) * 0.05
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, x[5].tolist()) for i in range(200)]  # a vector that many rows have
    got = es.search(table(spark, rows), F.col("vec_id") % 100 == 0, 10)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert result(got.collect()) == brute(rows, 10)


def test_pairs_that_cannot_reach_their_bound_are_not_computed():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(3000, 3)) @ rng.normal(size=(3, 32)) * 1024 + rng.normal(size=(3000, 32))).astype(np.int64)
    axes = np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1]
    ids, q = np.arange(3000), x[:300]
    exact = q @ x.T
    exact[np.arange(300), np.arange(300)] = np.iinfo(np.int64).min
    bound = np.sort(exact, axis=1)[:, -10]
    i, j, scores, computed = es.best_of_block(ids[:300], q, bound, ids, x, axes, 10)
    assert computed < 0.02 * 300 * 3000
    assert (scores == exact[i, j]).all() and (np.bincount(i) == 10).all()


def test_long_vectors_stay_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.integers(-(2**29), 2**29, size=(150, 3)) / 1024)]
    rows = [(i, [*v[:2], 2.0**20 + i]) for i, v in rows]
    assert result(es.search(table(spark, rows), F.col("vec_id") % 100 == 0, 10).collect()) == brute(rows, 10)


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0])]
    rows += [(7, [float("inf"), 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (100, None), (1, [2.0, 1.0]), (9, [1e200, 0.0])]
    rows += [(200, [0.0, 0.0]), (10, [-1.0, -0.0001])]
    got = result(es.search(table(spark, rows), F.col("vec_id") % 100 == 0, 10).collect())
    kept = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (4, [0.0, 0.0]), (200, [0.0, 0.0]), (10, [-1.0, -0.0001])]
    assert got == brute(kept, 10)
    assert es.search(table(spark, rows), F.col("vec_id") == 99, 3).count() == 0
    empty = es.search(table(spark, rows).limit(0), F.col("vec_id") == 0)
    assert empty.count() == 0 and empty.columns == ["query_id", "rank", "vec_id", "score"]


def test_an_id_with_several_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 2.0]), (1, [3.0, 0.5])]
    got = es.search(table(spark, rows), F.col("vec_id") == 0, 10).collect()
    s = 1024 * 1024
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 1, 3 * s), (2, 1, 2 * s), (3, 1, s), (4, 1, s // 2)]
