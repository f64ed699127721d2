from __future__ import annotations

import random

import numpy as np
import pytest
from words import ODD, words

from spokeworks.llm import ngram_join as ng
from spokeworks.llm.batches import ascii_words, shingle_set
from spokeworks.operators.staging import stage


def sets(value):
    own = ascii_words(value) if value else []
    k = min(5, len(own))
    return {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if own else set()


def brute(rows):
    known = [(i, sets(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in known}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(known)):
        for b in range(a):
            x, y = known[a][1], known[b][1]
            shared = len(x & y)
            if x and y and 100 * shared >= 75 * (len(x) + len(y) - shared):
                u, v = root(known[a][0]), root(known[b][0])
                parent[max(u, v)] = min(u, v)
    return {i: (len(s), root(i)) for i, s in known}


def check(spark, documents, rows):
    got = ng.classes(documents(*rows, extra="sig kind a b")).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == brute(rows)


def edited(rng, own, share):
    own = list(own)
    for _ in range(round(share * len(own))):
        at = rng.randrange(len(own))
        own[at : at + 1] = words(rng, rng.choice([0, 1, 1, 1, 2]))
    return own


def near_copies(rng, n):
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            base = ascii_words(rng.choice(rows)[1])
            own = edited(rng, [w.decode() for w in base], rng.choice([0, 0.01, 0.02, 0.03, 0.05, 0.08]))
        else:
            own = words(rng, rng.choice([1, 2, 4, 5, 6, 7, 9, 14, 30, 80, 200]))
        rows.append((i, " ".join(own) or "x"))
    rng.shuffle(rows)
    return rows


def test_same_as_all_pairs(spark, documents):
    check(spark, documents, near_copies(random.Random(1), 260))


def test_large_buckets_are_compared_in_blocks(spark, documents, monkeypatch):
    """A passage that nearly all texts share makes large buckets between many components."""
    monkeypatch.setattr(ng, "PAIRED", 2)
    monkeypatch.setattr(ng, "SMALL", 3)
    monkeypatch.setattr(ng, "BLOCK", 5)
    rng = random.Random(3)
    passage = words(rng, 40)
    rows = []
    for i in range(150):
        own = passage + words(rng, rng.choice([4, 8, 10, 12, 14, 40]))
        rows.append((i, " ".join(edited(rng, own, rng.choice([0, 0, 0.02])))))
    check(spark, documents, rows)


def block_pairs(spark, sketched, asking, members):
    """Pairs of one large bucket; members as ``doc_id, margin``, each of a component of its own."""
    rows = [(7, i, 2, m, i, i in asking, i in asking) for i, m in members]
    schema = "sig LONG, doc_id LONG, kind BYTE, margin BYTE, part LONG, asks BOOLEAN, asker BOOLEAN"
    return {(r["a"], r["b"]) for r in ng._block_pairs(spark.createDataFrame(rows, schema), sketched).collect()}


def test_a_set_without_margin_is_found_by_those_that_ask(spark, documents):
    """It doesn't ask, and can't find a partner by its whole segments itself; one with a margin could."""
    base = words(random.Random(6), 30)
    texts = [(i, " ".join([*base[:-1], f"end{i}"])) for i in range(4)]
    sketched = ng.sketches(documents(*texts).select("doc_id", "text"))
    assert block_pairs(spark, sketched, [1, 3], [(0, -1), (1, 0), (2, 5), (3, 0)]) == {(0, 1), (0, 3), (1, 3)}


def test_larger_buckets_wait_for_smaller_ones(spark, documents, monkeypatch):
    """Near copies come together in few rounds; then the buckets that all of them share are one component."""
    monkeypatch.setattr(ng, "SMALL", 3)
    monkeypatch.setattr(ng, "GROWTH", 2)
    rng = random.Random(10)
    base = words(rng, 120)
    rows = [(i, " ".join(edited(rng, base, 0.012))) for i in range(120)]
    sizes = []
    real = ng._block_pairs
    monkeypatch.setattr(ng, "_block_pairs", lambda rows, sketched: sizes.append(rows.count()) or real(rows, sketched))
    check(spark, documents, rows + [(1000 + i, t) for i, t in near_copies(rng, 60)])
    assert sizes == sorted(sizes) or len(sizes) < 12


def test_short_texts_with_too_few_neighbourhoods(spark, documents):
    """Seven shingles that all fall in one of four segments have partners that rely on neighbourhoods."""
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        own = words(rng, 11)
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(own[:-1] + words(rng, 1)))]
    got = {r["doc_id"]: r["component_id"] for r in ng.classes(documents(*rows)).collect()}
    assert [i for i in got if got[i] != i - i % 2] == []


@pytest.mark.parametrize("first", [0, 1])
def test_blocks_meet_every_text_of_an_id(spark, documents, first):
    rng = random.Random(8)
    base = words(rng, 30)
    texts = [(1, " ".join(words(rng, 30))), (1, " ".join([*base, "end"]))]
    rows = [texts[first], texts[1 - first], (2, " ".join(base))]
    sketched = ng.sketches(documents(*rows).select("doc_id", "text").coalesce(1))
    assert block_pairs(spark, sketched, [2], [(1, -1), (2, 0)]) == {(1, 2)}


def test_copies_beyond_the_broadcast_bound(spark, documents, monkeypatch):
    monkeypatch.setattr(ng, "KNOWN_IDS", 0)
    rng = random.Random(7)
    own = [" ".join(words(rng, 30)) for _ in range(5)]
    check(spark, documents, [(i, own[i % 5]) for i in range(60)])


def test_the_threshold_itself(spark, documents):
    """Sets of 7 and 7 that share 6 are at 6/8; of 4 and 3 that share 3 at 3/4; 11 more are just below."""
    base = "a b c d e f g h i j k".split()
    rows = [(1, " ".join(base)), (2, " ".join([*base[:-1], "z"])), (3, " ".join(base[:8])), (4, " ".join(base[1:8])), (5, " ".join(["q", *base[2:]]))]
    check(spark, documents, rows)


def test_odd_texts_and_ids(spark, documents):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, t) for i, t in enumerate(ODD)]
    check(spark, documents, rows)
    got = ng.classes(documents((None, "a b"), (None, None), (4, "A  b"), (4, "a b"), (3, "a b"))).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in got if r["doc_id"]) == [(3, 1, 3), (4, 1, 3), (4, 1, 3)]
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None, None]
    assert ng.classes(documents((1, "a")).limit(0)).count() == 0


def test_one_of_each_class_is_kept(spark, documents):
    df = documents((1, "a b c"), (5, "a b c"), (2, "x y"), (3, None), (2, "x y"), (None, "a b c"), (None, "q"))
    got = ng.without_near_copies(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == sorted(
        [(1, "a b c"), (2, "x y"), (3, None), (0, "a b c"), (0, "q")], key=lambda r: (r[0], r[1] or "")
    ) or sorted((r["doc_id"] or 0) for r in got.collect()) == [0, 0, 1, 2, 3]


def test_allowances_cover_every_pair():
    for a in range(1, 400):
        for b in range(a, min(a * 100 // 75 + 2, 400)):
            least_shared = next((s for s in range(a + 1) if 100 * s >= 75 * (a + b - s)), None)
            if least_shared is None:
                continue
            apart = a + b - 2 * least_shared
            assert apart <= ng.differences(a, b)
            mine = {level: (m, allowed) for level, m, allowed in ng.levels(a)}
            own = ng.levels(b)[0]
            assert own[0] in mine  # the larger set's own level has the smaller one
            assert mine[own[0]][0] == own[1]
            assert ng.differences(a, b) <= min(mine[own[0]][1], own[2])


def test_parities_never_rule_out_a_link():
    rng = random.Random(5)
    for _ in range(60):
        x = words(rng, rng.randint(5, 300))
        y = edited(rng, x, rng.random() * 0.1)
        a, b = (shingle_set(" ".join(w)) for w in (x, y))
        if not len(a) or not len(b):
            continue
        apart = len(np.setxor1d(a, b))
        assert ng._apart(ng._sketch(a)[2], ng._sketch(b)[2]) <= apart


@pytest.mark.parametrize("value", ["", "a", "a b c d e", "a b c d e f", "A b\tC d e\nf a b c d e"])
def test_shingles(value):
    assert len(shingle_set(value)) == len(sets(value))


def test_only_sketches_of_pairs_are_moved(spark, monkeypatch):
    texts = [(i, " ".join(f"w{k}" for k in range(i % 3, 40))) for i in range(9)]
    sketched = stage(ng.sketches(spark.createDataFrame(texts, "doc_id LONG, text STRING")), "sketches")
    pairs = spark.createDataFrame([(0, 1), (0, 3)], "a LONG, b LONG")
    likely = ng._likely(pairs, sketched)
    assert "LeftSemi" in likely._jdf.queryExecution().executedPlan().toString()
    found = sorted(map(tuple, likely.collect()))
    monkeypatch.setattr(ng, "KNOWN_IDS", 0)  # ids that are too many pick nothing
    other = ng._likely(pairs, sketched)
    assert "LeftSemi" not in other._jdf.queryExecution().executedPlan().toString()
    assert found == sorted(map(tuple, other.collect())) == [(0, 1, 1), (0, 3, 0)]


def test_rounds_without_links_keep_the_open_buckets(spark, documents, monkeypatch):
    """Texts that share a passage and no more stay apart: who asks for which bucket doesn't change."""
    monkeypatch.setattr(ng, "SMALL", 3)
    monkeypatch.setattr(ng, "GROWTH", 2)
    labels = []
    monkeypatch.setattr(ng, "stage", lambda df, label: labels.append(label) or stage(df, label))
    rng = random.Random(12)
    passage = words(rng, 40)
    many = [(i, " ".join(passage + words(rng, 12 + i % 3))) for i in range(40)]
    few = [(100 + i, " ".join(passage[: 4 - i % 2] + passage[:30] + words(rng, 14))) for i in range(9)]
    check(spark, documents, many + few)
    assert labels.count("ngram-blocks") > 1
    assert labels.count("ngram-open") == labels.count("ngram-asking") == 1


def test_asking_sets_are_shuffled_once(spark):
    rows = [(s, d, 2, 0, 40, d) for s in range(3) for d in range(4)]
    open_ = spark.createDataFrame(rows, "sig LONG, doc_id LONG, kind BYTE, margin BYTE, size LONG, part LONG")
    asking = ng._asking(open_)
    assert asking._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    # of three unused buckets without a margin each set has to take all
    assert all(r["asks"] and r["asker"] for r in asking.collect())


def test_ids_of_few_pairs_are_not_shuffled(spark, monkeypatch):
    labels = []
    monkeypatch.setattr(ng, "stage", lambda df, label: labels.append(label) or stage(df, label))
    pairs = spark.createDataFrame([(0, 1), (0, 3)], "a LONG, b LONG")
    ids, few = ng._ids(pairs, "ids")
    assert few and labels == [] and sorted(r["doc_id"] for r in ids.collect()) == [0, 0, 1, 3]
    monkeypatch.setattr(ng, "FEW_PAIRS", 1)
    ids, few = ng._ids(pairs, "ids")
    assert few and labels == ["ids"] and sorted(r["doc_id"] for r in ids.collect()) == [0, 1, 3]


def test_signatures_have_48_bits():
    own = shingle_set(" ".join(words(random.Random(4), 300)))
    for above in (0, 1):
        sig, _, _ = ng._whole(own, np.array([0, len(own)]), above)
        assert len(sig) and sig.min() >= 0 and sig.max() < 1 << 48
        near = [s for s, _ in ng._neighbourhoods(own, above)]
        assert max(s.max() for s in near) < 0 and min(s.min() for s in near) >= -(1 << 48)


def whole(value, above):
    sig, _, margin = ng._whole(value, np.array([0, len(value)]), above)
    return set(sig.tolist()), int(margin[0])


def test_links_share_more_than_their_reserve():
    """Rows beyond the reserve are left out; what is left of a link's two sets still meets often enough."""
    rng = random.Random(21)
    met = 0
    for _ in range(400):
        x = words(rng, rng.choice([60, 130, 200, 300, 420]))
        y = edited(rng, x, rng.choice([0, 0.01, 0.02, 0.03]))
        y = y[: len(y) - rng.choice([0, 0, len(y) // 10, len(y) // 5])]
        a, b = sorted((shingle_set(" ".join(w)) for w in (x, y)), key=len)
        for one in (a, b):
            for above in (0, 1):
                sig, margin = whole(one, above)
                _, _, allowed = ng.levels(len(one))[above]
                assert margin <= ng.RESERVE
                assert margin < 0 or len(sig) == allowed + 1 + margin
        shared = len(np.intersect1d(a, b))
        if 100 * shared < 75 * (len(a) + len(b) - shared):
            continue
        level = ng.levels(len(b))[0][0]
        above = [v for v, *_ in ng.levels(len(a))].index(level)
        (left, spare_a), (right, spare_b) = whole(a, above), whole(b, 0)
        assert len(left & right) > max(spare_a, spare_b)
        met += min(spare_a, spare_b) >= 0
    assert met > 50


def test_pairs_move_half_of_long_sketches(spark):
    rng = random.Random(22)
    base = words(rng, 300)
    texts = [(0, " ".join(base)), (1, " ".join(edited(rng, base, 0.01))), (2, " ".join(words(rng, 300))), (3, "a b c")]
    sketched = stage(ng.sketches(spark.createDataFrame(texts, "doc_id LONG, text STRING")), "sketches")
    full = {r["doc_id"]: len(r["bits"]) for r in sketched.collect()}
    half = {r["doc_id"]: len(r["bits"]) for r in ng._coarse(sketched).collect()}
    assert half == {0: full[0] // 2, 1: full[1] // 2, 2: full[2] // 2, 3: full[3]}
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "a LONG, b LONG")
    likely = ng._likely(pairs, sketched)
    assert [(r["a"], r["b"]) for r in likely.collect()] == [(0, 1)]


def test_pairs_of_blocks_are_not_sketched_again(spark, documents, monkeypatch):
    """They come with all bits compared; only pairs of small buckets, twice, are told apart by sketches."""
    monkeypatch.setattr(ng, "SMALL", 3)
    monkeypatch.setattr(ng, "GROWTH", 2)
    labels = []
    monkeypatch.setattr(ng, "stage", lambda df, label: labels.append(label) or stage(df, label))
    rng = random.Random(12)
    passage = words(rng, 40)
    check(spark, documents, [(i, " ".join(passage + words(rng, 12 + i % 3))) for i in range(40)])
    assert labels.count("ngram-blocks") > 1
    assert labels.count("ngram-likely") == 2
