from __future__ import annotations

import random

import duckdb
import pytest
from words import ODD, words

from spokeworks.llm import mixing as mx


def sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    names = ("doc_id", "size", "source_size", "target", "taken", "copies")
    return con.execute(f"SELECT {', '.join(names)} FROM ({mx.ORACLE}) ORDER BY 1").fetchall()


def table(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id LONG, text STRING, source STRING, size LONG, rank STRING")


def corpus(rng, n, sources, share):
    rows = []
    for i in range(n):
        source = sources[0] if rng.random() < share else rng.choice(sources)
        rows.append((i, " ".join(words(rng, rng.choice([0, 1, 5, 20, 60]))), source))
    return rows


@pytest.mark.parametrize("sources, share", [(["b", "a", "é", "Z", None], 0.4), (["x"], 0.0), (["a", "b"], 0.95), (list("abcdefghijk"), 0.1)])
def test_same_as_sql(spark, monkeypatch, sources, share):
    monkeypatch.setattr(mx, "_ROWS_PER_BUCKET", 20)
    rows = corpus(random.Random(len(sources)), 300, sources, share)
    got = mx.mix(table(spark, rows)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == sql(rows)
    taken, target, longest = {}, {}, {}
    for (_, _, source), r in zip(rows, got, strict=True):
        taken[source] = taken.get(source, 0) + r["taken"]
        target[source] = r["target"]
        longest[source] = max(longest.get(source, 0), r["size"])
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert sum(target.values()) == pytest.approx(1.5 * sum(r["size"] for r in got))
    assert all(abs(taken[s] - target[s]) <= 2 * longest[s] for s in taken)


def targets_round_by_round(sizes):
    """Shares by weight; what exceeds a bound is shared again until nothing does."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = budget - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return {**share, **fixed}
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_targets(spark):
    rng = random.Random(6)
    for _ in range(6):
        sizes = {s: rng.choice([0, 1, 10, 200, 5000]) for s in ["a", "b", "B", "ß", None, "zz"]}
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source STRING, size LONG")
        got = {r["source"]: r["target"] for r in mx.targets(df).collect()}
        assert got == pytest.approx(targets_round_by_round(sizes))


def test_odd_rows(spark):
    rows = [(i % 5 or None, t, None if i % 2 else "s") for i, t in enumerate(ODD)]
    got = mx.mix(table(spark, rows)).collect()
    assert len(got) == len(rows)
    again = mx.mix(table(spark, list(reversed(rows)))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mx.mix(table(spark, rows).limit(0)).count() == 0
    blank = mx.mix(table(spark, [(1, None, "a"), (2, " ", "b")])).collect()
    assert {(r["target"], r["taken"]) for r in blank} == {(0.0, 0)}


@pytest.mark.parametrize("bound", [10**6, 0])
def test_documents_come_as_often_as_taken(spark, monkeypatch, bound):
    monkeypatch.setattr(mx, "KNOWN_IDS", bound)
    df = table(spark, corpus(random.Random(1), 80, ["a", "b", "c"], 0.3))
    copies = {r["doc_id"]: r["copies"] for r in mx.mix(df).collect() if r["copies"]}
    got = mx.mixed(df)
    assert got.columns == df.columns
    counts = {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert counts == copies
