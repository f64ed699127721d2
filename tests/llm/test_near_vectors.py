from __future__ import annotations

import numpy as np
import pytest

from spokeworks.llm import near_vectors as nv

SCHEMA = "vec_id LONG, embedding ARRAY<DOUBLE>, weight INT, links INT, key INT"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 0, 0) for i, v in rows], SCHEMA)


def brute(rows, threshold=nv.THRESHOLD):
    good = {}
    for i, v in rows:
        if i is None or v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good[i] = np.array(v, float)
    ids = sorted(good)
    links = {i: set() for i, _ in rows if i is not None}
    for a in ids:
        for b in ids:
            x, y = good[a], good[b]
            if a < b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[a].add(b)
                links[b].add(a)
    parent = {i: i for i in links}
    changed = True
    while changed:
        changed = False
        for a in links:
            low = min([parent[a], *(parent[b] for b in links[a])])
            if low < parent[a]:
                parent[a], changed = low, True
    return {i: (len(links[i]), parent[i], parent[i] == i) for i in links}


def groups(rng, n, width, copies):
    rows = [(i, rng.normal(size=width)) for i in range(n)]
    for k in range(copies):
        base = rows[k % 7][1]
        rows.append((n + k, base * rng.uniform(0.5, 2) + rng.normal(size=width) * rng.choice([0.0, 0.05, 0.25, 0.4])))
    return rows


@pytest.mark.parametrize("width, block", [(64, 1024), (64, 16), (8, 20), (2, 8), (1, 4)])
def test_same_as_all_pairs(spark, monkeypatch, width, block):
    monkeypatch.setattr(nv, "BLOCK", block)
    rng = np.random.default_rng(width + block)
    rows = groups(rng, 60, width, 90)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in nv.near_duplicates(table(spark, rows)).collect()}
    assert got == brute(rows)


def test_equal_vectors_and_odd_ones(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(10 + k, same) for k in range(40)]
    rows += [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 3.0]), (5, [1.0, float("nan"), 3.0]), (6, [1.0, float("inf"), 3.0])]
    rows += [(7, [1.0, 2.0]), (8, [2.0, 4.0, 6.0]), (9, [-1.0, -2.0, -3.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in nv.near_duplicates(table(spark, rows)).collect()}
    assert got == brute(rows)
    assert got[8] == (40, 8, True) and got[10] == (40, 8, False)
    none = nv.near_duplicates(table(spark, [(None, same), (1, same)])).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in none) == [(0, 0, None, False), (1, 0, 1, True)]
    empty = nv.near_duplicates(table(spark, [(1, same)]).limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "n_links", "component_id", "kept"]


def test_estimates_are_unbiased_within_their_bounds():
    rng = np.random.default_rng(0)
    width = 64
    x = rng.normal(size=(400, width))
    x /= np.linalg.norm(x, axis=1)[:, None]
    turned = x @ nv.rotations(width, width)
    correction = np.abs(turned).sum(axis=1) / np.sqrt(width)
    estimate = np.sign(turned) @ turned.T / np.sqrt(width) / correction[:, None]
    error = estimate - x @ x.T
    off = ~np.eye(len(x), dtype=bool)
    assert abs(error[off].mean()) < 2e-3
    bound = nv.CONFIDENCE * np.sqrt(1 - correction**2) / correction / np.sqrt(width - 1)
    assert (np.abs(error) <= bound[:, None] + 1e-9)[off].mean() > 0.999
    assert np.diag(error) == pytest.approx(0, abs=1e-9)


def test_pieces_reach_pairs_at_the_threshold():
    for rows in (10, 1000, 10**6, 10**9):
        bits, pieces = nv.tables(rows)
        together = (1 - np.arccos(nv.THRESHOLD) / np.pi) ** bits
        assert (1 - together) ** pieces <= nv.MISSED
    assert nv.tables(10**9)[0] > nv.tables(1000)[0]
