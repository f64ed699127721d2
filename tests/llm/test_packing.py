from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from words import ODD, text

from spokeworks.llm import packing as pk

PATH = public_tokenizers.path("word_bpe_49k.json")
MORE = [
    "a\x85b\x1cc", "İstanbul ŒUVRE ﬁn", "<|startoftext|> x<|endoftext|>y", "école ́x ½²ª º\xadx",
    "don't DON'T they'll 's''t", "ΣΑΣ Σ ǅ Ŀ ŉ", "a-b_c...!!! 123 4 56abc", "ﬀ ⅷ Å Ω",
]


def ids(value):
    return [*Tokenizer.from_file(PATH).encode(value or "", add_special_tokens=False).ids, pk.END]


def test_ids_are_those_of_the_tokenizer():
    for value in [*ODD, *MORE, *(text(random.Random(k), 60) for k in range(5))]:
        assert np.frombuffer(pk.token_bytes(value, PATH), "<u4").tolist() == ids(value)


def test_the_cache_is_bounded(monkeypatch):
    words = pk._Words(PATH)
    words.MOST = words.runs.MOST = 3
    for w in "the of and to in".split():
        assert np.frombuffer(words[w.encode()], "<u4").tolist() == ids(w)[:-1]
    assert len(words) <= 3 and len(words.runs) <= 3


def checked(placed, size):
    rows = placed.collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return rows, len(by_sequence)


def test_documents_are_cut_and_packed(documents):
    rng = random.Random(1)
    rows = [(i, text(rng, rng.choice([0, 1, 3, 10, 40, 90]))) for i in range(200)] + [(500 + i, t) for i, t in enumerate(ODD[:10])]
    df = documents(*rows, extra="length offset")
    size = 64
    got, n = checked(pk.pack(pk.pieces(df, PATH, size), size), size)
    for i, value in rows:
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        want = np.array(ids(value), "<u4")
        assert [r["start"] for r in own] == list(range(0, len(want), size))
        for r in own:
            part = want[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
        assert sum(r["length"] for r in own) == len(want)
    total = sum(r["length"] for r in got)
    assert n <= 1.05 * -(-total // size) + 1


def test_sequences_hold_the_ids(documents):
    rows = [(i, text(random.Random(i), 20)) for i in range(30)]
    placed = pk.pack(pk.pieces(documents(*rows), PATH, 100, ids=True), 100)
    found = Counter()
    for r in pk.sequences(placed).collect():
        assert len(r["ids"]) <= 100
        found.update(r["ids"])
    assert found == Counter(x for _, value in rows for x in ids(value))


def test_repeated_and_empty_rows(documents):
    df = documents(*[(7, "a b c")] * 50, *[(None, None)] * 30, (8, ""))
    got, _ = checked(pk.pack(pk.pieces(df, PATH, 8), 8), 8)
    assert len(got) == 81
    assert Counter(r["doc_id"] for r in got) == {7: 50, None: 30, 8: 1}
    assert pk.pack(pk.pieces(df.limit(0), PATH)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_bulk_best_fit_is_as_good_as_one_by_one(seed):
    rng = random.Random(seed)
    size = 50
    lengths = [rng.choice([rng.randint(1, size), rng.randint(1, 12)]) for _ in range(rng.randint(1, 300))]
    placed = pk.best_fit(dict(Counter(lengths)), size)
    filled, ranks = Counter(), Counter()
    for length, lo, hi, first, offset in placed:
        assert lo == ranks[length]
        ranks[length] = hi
        for r in range(hi - lo):
            assert filled[first + r] == offset
            filled[first + r] += length
            assert filled[first + r] <= size
    assert ranks == Counter(lengths)
    gaps = []
    for length in sorted(lengths, reverse=True):  # best fit, document by document
        fits = [g for g in gaps if g >= length]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - length)
        else:
            gaps.append(size - length)
    assert len(filled) <= len(gaps)


def test_ranks_of_one_length_are_spread(documents, monkeypatch):
    monkeypatch.setattr(pk, "_ROWS_PER_BUCKET", 7)
    df = documents(*[(i, "a b c") for i in range(100)])
    got, n = checked(pk.pack(pk.pieces(df, PATH, 16), 16), 16)
    assert len(got) == 100 and n == 25


def test_runs_are_merged_as_by_the_vocabulary():
    """Single pieces against the whole tokenizer: words, mixed characters and long runs."""
    path = public_tokenizers.path("word_bpe_49k.json")
    words = pk._words(path)
    rng = random.Random(9)
    plain = [chr(c) for c in range(33, 0x250) if pk._PLAIN.fullmatch(chr(c))]
    for k in range(4000):
        letters = (plain, "abcdefghijklmnopqrstuvwxyzABC", "the in'll.-123é")[k % 3]
        piece = "".join(rng.choice(letters) for _ in range(rng.choice([1, 3, 8, 30, 200])))
        ids = words.tokenizer.encode(piece, add_special_tokens=False).ids
        assert words[piece.encode()] == np.array(ids, "<u4").tobytes()
