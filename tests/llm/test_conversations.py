from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from spokeworks.llm import conversations as cv

SCHEMA = "conv_id LONG, turn LONG, role STRING, text STRING, code STRING, copies STRING, hash STRING, part STRING"
LEGAL = re.compile("(s?(ua)+)?")
WHITE = " \t\n\x0b\x0c\r"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def after_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest())
    return {conv: sorted(own, key=order) for conv, own in out.items()}


def faults(own):
    seen, out = set(), []
    for _, role, text in own:
        bare = text.rstrip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def edits(own, found, inserts=None):
    """Least cost and audit with what stays: every sequence of edits, by the roles it has written so far."""
    best = {(0, ""): (0, "", ())}
    todo = [(0, "")]
    n = len(own)
    longest = n + 4 if inserts is None else n + inserts

    def offer(key, value):
        if len(key[1]) <= longest and re.fullmatch("s?(ua)*u?", key[1]) and (key not in best or value[:2] < best[key][:2]):
            best[key] = value
            todo.append(key)

    while todo:
        at, written = key = todo.pop(0)
        cost, audit, kept = best[key]
        for role in ("user", "assistant"):
            offer((at, written + role[0]), (cost + 5, audit + "I", (*kept, f"{role}:")))
        if at == n:
            continue
        _, role, text = own[at]
        offer((at + 1, written), (cost + 2, audit + "D", kept))
        if found[at] in ("", "truncated"):
            more = 5 * (found[at] == "truncated")
            if role:
                offer((at + 1, written + role[0]), (cost + more, audit + "K", (*kept, f"{role}:{text}")))
            for new in ("user", "assistant"):
                offer((at + 1, written + new[0]), (cost + more + 1, audit + "R", (*kept, f"{new}:{text}")))
    return min((v for (at, written), v in best.items() if at == n and LEGAL.fullmatch(written)), key=lambda v: v[:2])


def brute(rows):
    out = []
    for conv, own in after_damage(rows).items():
        found = faults(own)
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, kept = edits(own, found)
        kinds = [found.count(k) for k in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *kinds, illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(rng, n, longest):
    rows = []
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]
    texts = ["Yes.", "No!", "Why?", "and then", "", " \n", None, "é…", "Same. \t", "x." * 40]
    for conv in range(n):
        turn = rng.choice([0, 0, 5, -3])
        for k in range(rng.randint(1, longest)):
            turn += rng.choice([0, 1, 1, 1, 1, 3])
            role = rng.choice(roles) if rng.random() < 0.3 else roles[1 + k % 2]
            rows.append((conv, None if rng.random() < 0.03 else turn, role, rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.randint(0, 99)}."))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [1024, 2, 5])
def test_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(cv, "CHUNK", chunk)
    rng = random.Random(1)
    rows = conversations(rng, 150, 9) + [(None, 1, "user", "A."), (None, None, None, None), (None, 2, "assistant", "B.")]
    rows += [(900, 1, "user", "Again.")] * 30 + [(901, t, "user", "Again.") for t in range(25)]
    rows += [(902, t, ("user", "assistant")[t % 2], f"T{t}.") for t in range(60)]
    got = cv.repair(cv.damaged(table(spark, rows)))
    assert got.columns == "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_both_ends_meet_at_the_least_audit():
    """Against every sequence of edits of short conversations, code by code."""
    names = {0: "x", 1: "system", 2: "user", 3: "assistant"}
    kinds = {0: "", 1: "blank", 3: "truncated"}
    for n in range(4):
        for codes in itertools.product([4 * i + f for i in range(4) for f in (0, 1, 3)], repeat=n):
            own = [(k, names[c >> 2], f"{k}.") for k, c in enumerate(codes)]
            assert cv.cheapest(codes) == edits(own, [kinds[c & 3] for c in codes], inserts=4)[:2]
    rng = random.Random(2)
    for _ in range(300):
        codes = [4 * rng.choice([0, 1, 2, 2, 2, 3, 3, 3]) + rng.choice([0, 0, 0, 1, 3]) for _ in range(rng.randint(4, 30))]
        own = [(k, names[c >> 2], f"{k}.") for k, c in enumerate(codes)]
        assert cv.cheapest(codes) == edits(own, [kinds[c & 3] for c in codes], inserts=0)[:2]


def test_nothing_is_left(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    nothing = hashlib.sha256(b"").hexdigest()
    got = cv.repair(cv.damaged(table(spark, [(dropped, 0, "user", "Hi.")]))).collect()
    assert [tuple(r) for r in got] == [(dropped, 0, 0, 0, 0, 0, 0, "", nothing)]
    assert cv.repair(cv.damaged(table(spark, [(1, 1, "a", "b")]).limit(0))).count() == 0


def test_long_texts_and_extreme_turns(spark):
    rows = [(7, -(2**63), "user", "a" * 300_000 + "."), (7, 2**63 - 1, "assistant", "word " * 100_000 + "!")]
    got = [r for r in cv.repair(cv.damaged(table(spark, rows))).collect()]
    want = brute(rows)[0]
    assert tuple(got[0])[0] == want[0] and tuple(got[0])[2:] == want[2:]
    assert got[0]["gaps"] == min(want[1], 2**63 - 1)
