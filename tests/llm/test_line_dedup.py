from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest
from words import ODD, words

from spokeworks.llm import line_dedup as ld


def brute(rows, min_words):
    """Lines of the longest run from each line that also starts before, if it has enough words.

    And lines without words between two such lines.
    """
    lines = {}
    for i, t in rows:
        every = (t or "").split("\n")
        lines[i] = [(no, x, len(re.findall(r"\S+", x))) for no, x in enumerate(every) if re.search(r"\S", x)]
    seen, out = defaultdict(list), defaultdict(set)
    for i in sorted(lines):
        own = lines[i]
        for a in range(len(own)):
            best = 0
            for j, b in seen[own[a][1]]:
                other, k = lines[j], 0
                while a + k < len(own) and b + k < len(other) and own[a + k][1] == other[b + k][1]:
                    k += 1
                best = max(best, k)
            if sum(x[2] for x in own[a : a + best]) >= min_words and best:
                out[i].update(x[0] for x in own[a : a + best])
            seen[own[a][1]].append((i, a))
        for x, y in zip(own, own[1:]):
            if {x[0], y[0]} <= out[i]:
                out[i].update(range(x[0], y[0]))
    return out


def texts(rng, n, pool=25):
    lines = [" ".join(words(rng, rng.choice([1, 1, 2, 3, 5, 8]))) for _ in range(pool)] + ["", "  "]
    runs = [[rng.choice(lines) for _ in range(rng.randint(2, 9))] for _ in range(6)]
    out = []
    for i in range(n):
        own = []
        for _ in range(rng.randint(0, 6)):
            own += rng.choice(runs) if rng.random() < 0.5 else [rng.choice(lines)]
        out.append((i, "\n".join(own)))
    return out


@pytest.mark.parametrize("min_words", [1, 2, 7, 16, 40])
def test_same_as_brute_force(documents, min_words):
    rows = texts(random.Random(min_words), 60)
    got = ld.without_repeats(documents(*rows, extra="h class start"), min_words).collect()
    want = brute(rows, min_words)
    for r in got:
        value = dict(rows)[r["doc_id"]]
        kept = [x for no, x in enumerate(value.split("\n")) if no not in want[r["doc_id"]]]
        assert r["text"] == "\n".join(kept)
        assert (r["_lines"], r["_removed"]) == (len(value.split("\n")), len(want[r["doc_id"]]))
    assert any(r["_removed"] for r in got) or min_words == 40


def test_runs_beyond_the_broadcast_bound(documents, monkeypatch):
    monkeypatch.setattr(ld, "KNOWN_RUNS", 0)
    rows = texts(random.Random(3), 40)
    want = brute(rows, 5)
    got = ld.without_repeats(documents(*rows), 5).collect()
    assert {r["doc_id"]: r["_removed"] for r in got} == {i: len(want[i]) for i, _ in rows}


def test_odd_rows(documents):
    run = "one two three\nfour five six"
    df = documents((2, run), (None, run), (3, None), (4, ""), (2, run), (5, f"x\n{run}\ny"))
    got = ld.without_repeats(df, 6).collect()
    assert [r["text"] for r in got if r["doc_id"] is None] == [run]  # null comes first
    assert [r["text"] for r in got if r["doc_id"] == 2] == ["", ""]
    assert [r["text"] for r in got if r["doc_id"] == 5] == ["x\ny"]
    assert [(r["text"], r["_lines"], r["_removed"]) for r in got if r["doc_id"] in (3, 4)] in ([(None, 0, 0), ("", 1, 0)], [("", 1, 0), (None, 0, 0)])
    odd = documents(*[(i, t) for i, t in enumerate(ODD)])
    assert {r["doc_id"]: r["text"] for r in ld.without_repeats(odd).collect()} == dict(enumerate(ODD))
    assert ld.without_repeats(df.limit(0)).count() == 0


def test_a_long_text_of_many_lines(documents):
    lines = [f"line {i} of a long text" for i in range(3000)]
    got = {r["doc_id"]: r for r in ld.without_repeats(documents((1, "\n".join(lines)), (2, "\n".join(["new", *lines[500:2500], "end"])))).collect()}
    assert got[1]["_removed"] == 0
    assert got[2]["text"] == "new\nend"


def test_no_python_in_the_plan(documents):
    plan = ld.without_repeats(documents((1, "a\nb")))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
