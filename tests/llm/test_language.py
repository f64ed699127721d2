from __future__ import annotations

import itertools
import math
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from words import ODD

from spokeworks.llm import language as lg

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def pieces():
    model = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    hashes, numbers, _ = lg._vocabulary(VOCABULARY)
    found = []
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i)
        bare = p.removeprefix(lg.WORD_START)
        if len(p) <= lg.LONGEST_PIECE and bare and lg.LETTERS.fullmatch(bare) and bare == bare.lower():
            found.append(p)
    return {p: k for k, p in enumerate(found)}


def all_segmentations(word, table, probability):
    """The probability of a word, one segmentation after the other, and expected uses of pieces."""
    marked = lg.WORD_START + word
    total, uses = 0.0, {}
    for cuts in itertools.product((0, 1), repeat=len(marked) - 1):
        parts, at = [], 0
        for i, cut in enumerate((*cuts, 1), 1):
            if cut:
                parts.append(marked[at:i])
                at = i
        numbers = [table.get(p, len(table) if len(p) == 1 else None) for p in parts]
        if None in numbers:
            continue
        p = math.prod(probability[k] for k in numbers)
        total += p
        for k in numbers:
            uses[k] = uses.get(k, 0.0) + p
    return total, {k: v / total for k, v in uses.items()}


def test_forward_sums_all_segmentations():
    table = pieces()
    rng = np.random.default_rng(3)
    probability = rng.random((len(table) + 1, 2)) * 1e-3
    for length in (1, 2, 5, 8):
        sample = random.Random(length)
        words = ["".join(sample.choice("thenarioséß") for _ in range(length)) for _ in range(4)]
        words += ["日" * length]
        lattice = lg.Lattice(words, VOCABULARY)
        _, log = lattice.forward(probability)
        uses = lattice.expected(probability, np.ones((len(words), 2)))
        want = np.zeros_like(uses)
        for w, word in enumerate(words):
            for k in range(2):
                total, expected = all_segmentations(word, table, probability[:, k])
                assert log[w, k] == pytest.approx(math.log(total), rel=1e-9)
                for piece, n in expected.items():
                    want[piece, k] += n
        assert uses == pytest.approx(want, abs=1e-9)


def test_a_very_long_word_does_not_underflow():
    model = lg.Model(["a", "b"], np.zeros(2), np.full((lg.pieces_in_vocabulary(VOCABULARY) + 1, 2), 1e-5), VOCABULARY)
    word = "the" * 3000
    model.learn([word])
    assert np.isfinite(model.score([word])).all()


LANGS = {
    "en": "the of and to in is that for it on was with be as this are by from at have which".split(),
    "fr": "le la les des une est dans que qui pour sur avec pas plus par être cette mais nous vous".split(),
    "de": "der die das und ist nicht ein eine mit auf für von dem den sich auch werden wird nach über".split(),
}


def corpus(rng, n):
    return [(i, lang, " ".join(rng.choices(LANGS[lang], k=rng.randint(4, 40)))) for i in range(n) for lang in [rng.choice(sorted(LANGS))]]


def test_languages_of_unseen_texts(spark):
    rng = random.Random(8)
    learn = spark.createDataFrame([(i, t, lang, "x") for i, lang, t in corpus(rng, 150)], "doc_id LONG, text STRING, lang STRING, word STRING")
    model = lg.train(learn, VOCABULARY)
    fresh = corpus(rng, 200)
    got = lg.predict(spark.createDataFrame([(i, t) for i, _, t in fresh], "doc_id LONG, text STRING"), model).collect()
    truth = {i: lang for i, lang, _ in fresh}
    right = sum(r["lang_pred"] == truth[r["doc_id"]] for r in got)
    assert right >= 0.97 * len(fresh)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert model.probability.sum(axis=0) == pytest.approx(np.ones(3))


def test_odd_rows(spark, documents):
    learn = spark.createDataFrame([(1, "the of and", "en"), (2, "le la les", "fr"), (3, None, "en"), (4, "x", None)], "doc_id LONG, text STRING, lang STRING")
    model = lg.train(learn, VOCABULARY)
    assert model.languages == ["en", "fr"]
    df = documents(*[(i % 4 or None, t) for i, t in enumerate(ODD)], extra="score lang_pred")
    got = lg.predict(df, model).collect()
    assert len(got) == len(ODD)
    for r in lg.predict(documents((1, None), (2, ""), (3, "12 !? \n")), model).collect():
        assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert lg.predict(df.limit(0), model).count() == 0
    assert lg.train(learn.limit(0), VOCABULARY) is None
    assert {r["lang_pred"] for r in lg.predict(df, None).collect()} == {"und"}


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(lg, "MOST_LANGUAGES", 1)
    learn = spark.createDataFrame([("the", "en"), ("le", "fr")], "text STRING, lang STRING")
    with pytest.raises(ValueError, match="languages"):
        lg.train(learn, VOCABULARY)


def test_the_cache_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(lg, "CACHED_WORDS", 3)
    model = lg.Model(["a"], np.zeros(1), np.full((lg.pieces_in_vocabulary(VOCABULARY) + 1, 1), 1e-5), VOCABULARY)
    model.learn(["the", "of"])
    first = model.score(["the", "of"])
    model.learn(["and", "to", "in", "is"])
    model.learn(["the", "of"])
    assert model.score(["the", "of"]) == pytest.approx(first)
