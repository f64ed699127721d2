"""Language identification by unigram pieces, summed over all segmentations of a text.

A language gives each piece of a fixed public vocabulary a probability. The
probability of a word is the sum over every way to cut it into pieces; of a
text, the product over its words. Pieces don't cross word ends, so equal words
have equal probabilities and are worked out once per worker.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spokeworks.llm.batches import columns, slices
from spokeworks.operators.staging import stage

LETTERS = re.compile(r"[^\W\d_]+")
WORD_START = "▁"  # the mark of a piece that begins a word
LONGEST_PIECE = 16
MOST_LANGUAGES = 500  # a model has a row for each language: larger ones are an error, not cut
CACHED_WORDS = 200_000
_BASE = np.uint64(0x100000001B3)


def letter_words(text: str | None) -> list[str]:
    """Runs of letters in lower case; of a text without letters, none."""
    return LETTERS.findall(text.lower()) if text else []


def _hash(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the vocabulary's pieces made of letters, their numbers, a filter of hashes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        bare = piece.removeprefix(WORD_START)
        if len(piece) <= LONGEST_PIECE and bare and LETTERS.fullmatch(bare) and bare == bare.lower():
            pieces.append(piece)
    hashes = np.zeros(len(pieces), np.uint64)
    with np.errstate(over="ignore"):
        for i, piece in enumerate(pieces):
            h = np.uint64(0)
            for c in _hash(np.array([ord(c) for c in piece])):
                h = h * _BASE + c
            hashes[i] = h
    order = np.argsort(hashes)
    seen = np.zeros(1 << 20, bool)
    seen[hashes >> np.uint64(44)] = True
    return hashes[order], order, seen


def pieces_in_vocabulary(path: str) -> int:
    return len(_vocabulary(path)[0])


class Lattice:
    """Where pieces of the vocabulary stand in some words, each led by the word-start mark.

    Words of equal length are stacked; ``pieces[l][w, i]`` is the piece of
    length ``l + 1`` that begins at place ``i`` of word ``w``, or -1. A single
    character that is no piece counts as the unknown piece, so every word has a
    segmentation.
    """

    def __init__(self, words: list[str], path: str):
        hashes, numbers, seen = _vocabulary(path)
        self.unknown = len(hashes)
        self.length = len(words[0]) + 1
        text = "".join(WORD_START + w for w in words)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(words), -1)
        char = _hash(codes)
        rolled = np.zeros_like(char)
        self.pieces = []
        with np.errstate(over="ignore"):
            for k in range(min(LONGEST_PIECE, self.length)):
                rolled = rolled[:, : self.length - k] * _BASE + char[:, k:]
                found = np.full(rolled.shape, -1, np.int64)
                likely = np.nonzero(seen[rolled >> np.uint64(44)])
                value = rolled[likely]
                at = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
                found[likely] = np.where(hashes[at] == value, numbers[at], -1)
                if k == 0:
                    found[found < 0] = self.unknown
                self.pieces.append(found)

    def forward(self, probability: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled sums over segmentations of every prefix, and the log of the whole, by language.

        ``probability`` has a row for each piece and the unknown one. Sums are
        rescaled at every place, so long words don't underflow.
        """
        words, langs = len(self.pieces[0]), probability.shape[1]
        padded = np.vstack([probability, np.zeros((1, langs))])  # -1 is no piece
        alpha = np.zeros((self.length + 1, words, langs))
        alpha[0] = 1.0
        log = np.zeros((words, langs))
        scale = np.ones((self.length + 1, words, langs))
        for end in range(1, self.length + 1):
            total = np.zeros((words, langs))
            carried = np.ones((words, langs))
            for k in range(min(len(self.pieces), end)):
                start = end - k - 1
                if k:
                    carried = carried / scale[start + 1]
                total += alpha[start] * carried * padded[self.pieces[k][:, start]]
            scale[end] = np.maximum(total, 1e-300)
            alpha[end] = total / scale[end]
            log += np.log(scale[end])
        self.scale = scale
        return alpha, log

    def expected(self, probability: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece by language, words counting ``weight[w, language]``."""
        alpha, _ = self.forward(probability)
        words, langs = len(self.pieces[0]), probability.shape[1]
        padded = np.vstack([probability, np.zeros((1, langs))])
        beta = np.zeros((self.length + 1, words, langs))
        beta[self.length] = 1.0
        uses = np.zeros_like(padded)
        for start in range(self.length - 1, -1, -1):
            carried = np.ones((words, langs))
            for k in range(min(len(self.pieces), self.length - start)):
                end = start + k + 1
                carried = carried / self.scale[end]
                piece = self.pieces[k][:, start]
                through = padded[piece] * carried * beta[end]
                beta[start] += through
                hit = piece >= 0
                if hit.any():
                    np.add.at(uses, piece[hit], (alpha[start] * through * weight)[hit])
        return uses[:-1]


def _by_length(words: list[str], most: int = 1 << 16) -> Iterator[list[int]]:
    """Places of words of equal length, of bounded size together."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for length, own in groups.items():
        step = max(1, most // (length + 1))
        for at in range(0, len(own), step):
            yield own[at : at + step]


@dataclass
class Model:
    """Log priors of languages, and per-language probabilities of pieces (pieces by languages)."""

    languages: list[str]
    prior: np.ndarray
    probability: np.ndarray
    vocabulary: str
    _known: dict[str, int] = field(default_factory=dict, repr=False)  # rows of _logs
    _logs: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_known": {}, "_logs": None}

    def learn(self, words: Iterable[str]) -> None:
        """Work out the log probabilities of words; a bounded number is kept for the next call."""
        wanted = set(words)
        new = [w for w in wanted if w not in self._known]
        if self._logs is None or len(self._known) + len(new) > CACHED_WORDS:
            self._known, new = {}, list(wanted)
            self._logs = np.zeros((max(CACHED_WORDS, len(new)), len(self.languages)))
        base = len(self._known)
        for own in _by_length(new):
            _, log = Lattice([new[i] for i in own], self.vocabulary).forward(self.probability)
            self._logs[[base + i for i in own]] = log
        self._known.update(zip(new, range(base, base + len(new)), strict=True))

    def score(self, words: list[str]) -> np.ndarray:
        return self.prior + self._logs[list(map(self._known.__getitem__, words))].sum(axis=0)


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, lang, n`` over all texts with a language; counted in tasks before the shuffle."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def flush():
            for lang, own in counts.items():
                words = list(own)
                for at in range(0, len(words), 1 << 16):
                    part = words[at : at + (1 << 16)]
                    yield pa.record_batch(
                        [pa.array(part), pa.array([lang] * len(part)), pa.array([own[w] for w in part], pa.int64())],
                        names=["word", "lang", "n"],
                    )
            counts.clear()

        for batch in slices(batches, "text"):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(letter_words(text))
            if sum(map(len, counts.values())) > CACHED_WORDS:
                yield from flush()
        yield from flush()

    parts = (
        columns(docs, text="string", lang="string")
        .where("text IS NOT NULL AND lang IS NOT NULL")
        .mapInArrow(task, "word string, lang string, n bigint")
    )
    return parts.groupBy("word", "lang").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, vocabulary: str, iterations: int = 2, smoothing: float = 0.1) -> Model | None:
    """Piece probabilities of each language by expectation-maximisation over all texts.

    Words are counted once for all rounds. A round sums expected uses in tasks;
    the driver gets them by language and piece, whose number is that of the
    vocabulary times the languages, however large the input. More than 500
    languages are an error. Without a word of a known language there is no model.
    """
    counts = stage(word_counts(docs), "language-words")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not totals:
        return None
    languages = sorted(totals)
    n = np.array([totals[x] for x in languages], float)
    pieces = pieces_in_vocabulary(vocabulary) + 1
    model = Model(languages, np.log(n / n.sum()), np.full((pieces, len(languages)), 1 / pieces), vocabulary)
    for _ in range(iterations):
        uses = np.zeros_like(model.probability)
        for r in _expected(counts, model).collect():
            uses[r["piece"]] = r["uses"]
        uses += smoothing
        model = Model(languages, model.prior, uses / uses.sum(axis=0), vocabulary)
    return model


def _expected(counts: DataFrame, model: Model) -> DataFrame:
    shared = counts.sparkSession.sparkContext.broadcast(model)
    langs = len(model.languages)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        place = {x: i for i, x in enumerate(own.languages)}
        uses = np.zeros_like(own.probability)
        for batch in batches:
            words = batch.column(0).to_pylist()
            lang = np.array([place[x] for x in batch.column(1).to_pylist()], int)
            n = batch.column(2).to_numpy(zero_copy_only=False)
            for part in _by_length(words):
                for k in np.unique(lang[part]):  # one language at a time: a column, not all
                    rows = [i for i in part if lang[i] == k]
                    lattice = Lattice([words[i] for i in rows], own.vocabulary)
                    column = own.probability[:, k : k + 1]
                    uses[:, k] += lattice.expected(column, n[rows][:, None])[:, 0]
        used = np.flatnonzero(uses.any(axis=1))
        yield pa.record_batch(
            [pa.array(used, pa.int32()), pa.array(uses[used].tolist(), pa.list_(pa.float64()))], names=["piece", "uses"]
        )

    parts = counts.mapInArrow(task, "piece int, uses array<double>")
    sums = [F.sum(F.col("uses")[i]).alias(f"u{i}") for i in range(langs)]
    return parts.groupBy("piece").agg(*sums).select("piece", F.array(*(f"u{i}" for i in range(langs))).alias("uses"))


UNKNOWN = "und"


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score`` of each row, from its whole text alone.

    ``score`` is the probability of the language among those known, by Bayes'
    rule. Text that is null or has no letter is ``und`` with score 0, as is all
    text without a model; of equally likely languages the first by name is
    taken. Rows with equal or null ids are scored row by row; other columns are
    ignored.
    """
    wanted = columns(docs, doc_id="bigint", text="string")
    if model is None:
        return wanted.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, "text"):
            texts = [letter_words(t) for t in batch.column(1).to_pylist()]
            own.learn(w for words in texts for w in words)
            langs, scores = [], []
            for words in texts:
                if not words:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                log = own.score(words)
                best = int(np.argmax(log))
                langs.append(own.languages[best])
                scores.append(float(1 / np.exp(log - log[best]).sum()))
            yield pa.record_batch(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return wanted.mapInArrow(task, "doc_id bigint, lang_pred string, score double")
