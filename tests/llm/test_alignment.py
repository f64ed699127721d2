from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from words import ODD, text

from spokeworks.llm import alignment as al
from spokeworks.llm.batches import byte_of_character

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def tokens(text):
    """Ids and byte strings of both sides, one token at a time, by the vocabularies' own libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    back = byte_of_character()
    a = tokenizer.encode(" " + text, add_special_tokens=False)
    b = model.encode(text)

    def piece(i):
        p = model.id_to_piece(i)
        return bytes.fromhex(p[3:5]) if model.is_byte(i) else p.replace("▁", " ").encode()

    return (a.ids, [bytes(back[c] for c in t) for t in a.tokens]), (b, [piece(i) for i in b])


def brute(docs):
    rows, links_of = [], []
    for doc, own in docs:
        groups, links, n_a, n_b = [], [], 0, 0
        if own:
            (ids_a, bytes_a), (ids_b, bytes_b) = tokens(own)
            raw = b" " + own.encode()
            if b"".join(bytes_a) == raw == b"".join(bytes_b):
                n_a, n_b = len(ids_a), len(ids_b)
                cover = [[], []]
                for side, parts in enumerate((bytes_a, bytes_b)):
                    for k, part in enumerate(parts):
                        cover[side] += [k] * len(part)
                pairs = dict.fromkeys(zip(*cover, strict=True))
                links = [(ids_a[i], ids_b[j]) for i, j in pairs]
                group, at = ([], []), [0, 0]
                sums = [0, 0]
                while at[0] < n_a or at[1] < n_b:
                    side = 0 if sums[0] <= sums[1] and at[0] < n_a else 1
                    group[side].append((ids_a, ids_b)[side][at[side]])
                    sums[side] += len((bytes_a, bytes_b)[side][at[side]])
                    at[side] += 1
                    if sums[0] == sums[1]:
                        groups.append("|".join(",".join(map(str, g)) for g in group))
                        group = ([], [])
        rows.append((doc, n_a, n_b, len(groups), len(links), ";".join(groups)))
        links_of.append(links)
    count = Counter(p for links in links_of for p in set(links))
    best = {}
    for (a, _), c in count.items():
        best[a] = max(best.get(a, 0), c)
    return sorted(
        (
            (doc, a, b, g, n, sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
             hashlib.sha256(own.encode()).hexdigest() if own else "")
            for (doc, a, b, g, n, own), links in zip(rows, links_of, strict=True)
        ),
        key=str,
    )


def test_against_brute_force(spark, documents, monkeypatch):
    monkeypatch.setattr(al, "BLOCK_ROWS", 7)
    rng = random.Random(3)
    own = [text(rng, rng.randint(1, 60)) for _ in range(40)] + ODD
    own += ["Größe der Übung und mehr", "привет, мир! 12345 ", "  two  spaces ", "日本語です。\n\n\tab", "áe‍", "▁ under ▁▁"]
    docs = [(i, t) for i, t in enumerate(own)] + [(None, "the same text"), (3, "the same text"), (3, "the same text")]
    got = al.align(documents(*docs, extra="block places code count best codes docs a"), A, B)
    assert got.columns == [c.split()[0] for c in al._ALIGNED.split(", ")]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs)


def test_an_empty_table_and_one_without_tokens(spark, documents):
    assert al.align(documents((1, "x")).limit(0), A, B).count() == 0
    got = al.align(documents((1, None), (2, "")), A, B).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_a_very_long_text(spark, documents):
    rng = random.Random(4)
    long = text(rng, 100_000)
    got = al.align(documents((1, long), (2, "short")), A, B).collect()
    row = next(r for r in got if r["doc_id"] == 1)
    (ids_a, bytes_a), (ids_b, bytes_b) = tokens(long)
    ends = [np.cumsum([len(x) for x in parts]) for parts in (bytes_a, bytes_b)]
    groups = len(np.intersect1d(*ends))
    assert (row["n_a"], row["n_b"], row["n_groups"]) == (len(ids_a), len(ids_b), groups)
    assert row["n_links"] == len(ids_a) + len(ids_b) - groups


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_pieces_of_a_merge(size):
    rng = np.random.default_rng(size)
    for _ in range(60):
        total = int(rng.integers(1, 40))
        a, b = (np.unique(np.append(rng.integers(1, total + 1, rng.integers(0, 30)), total)) for _ in range(2))
        i, j = al.split_merge(a, b, size)
        merged = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
        for k, (x, y) in enumerate(zip(i, j, strict=True)):
            head = merged[: k * size]
            assert k == len(i) - 1 or (x, y) == (sum(s == 0 for _, s in head), sum(s == 1 for _, s in head))
        assert (i[-1], j[-1]) == (len(a), len(b))
        of_a, of_b, last_a, last_b = al.overlaps(a, b, size)
        starts = [np.concatenate([[0], x[:-1]]) for x in (a, b)]
        want = {
            (x, y) for x in range(len(a)) for y in range(len(b)) if max(starts[0][x], starts[1][y]) < min(a[x], b[y])
        }
        assert sorted(zip(of_a.tolist(), of_b.tolist(), strict=True)) == sorted(want)
        assert a[last_a].tolist() == b[last_b].tolist() == np.intersect1d(a, b).tolist()


def test_both_libraries_give_the_same_ids():
    side = al.ByteLevel(A)
    rng = random.Random(5)
    plain = [chr(c) for c in range(0x10000) if al._PLAIN.fullmatch(chr(c))]
    latin = [c for c in plain if ord(c) < 0x250]
    for _ in range(3000):
        own = " " + "".join(rng.choice(rng.choice((plain, latin, " \n\t\r", "a1.'s"))) for _ in range(rng.randint(1, 25)))
        assert side.fast.encode_to_numpy(own, disallowed_special=()).tolist() == side.tokenizer.encode(own, add_special_tokens=False).ids
