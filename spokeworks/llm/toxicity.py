"""Toxic passages as maximum-scoring segments of word log-odds, calibrated by extreme values.

Each word, and each beginning of words, scores the log-odds of its use in toxic
against clean labelled texts under a Dirichlet prior; a word without a score of
its own takes that of its longest scored beginning, and words that don't tell
the classes apart a small negative drift. A linear scan finds every segment whose score can't be raised
by widening or narrowing it. Segment scores of clean text follow an
extreme-value law, which says how many segments that good a text of that
length has by chance. What exceeds it, added up over a text's segments, goes
through a logistic curve fitted to the labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spokeworks.llm.batches import columns, first_by_hash, slices
from spokeworks.llm.language import letter_words
from spokeworks.operators.staging import stage

DRIFT = 0.05  # score of a word that tells nothing, subtracted from the others as well
PRIOR_USES = 1000.0  # weight of the words' common distribution in the prior, in uses
PRIOR_EACH = 0.5  # what the prior has of every word besides
STEMS = range(4, 8)  # lengths of word beginnings that are scored like words
LEAST_Z = 3.0  # a word counts when its log-odds exceed so many standard deviations
MOST_WORDS = 2_000_000  # words of a model, which every worker holds; more are an error, for a larger LEAST_Z
SEEN_WORDS = 300_000  # scores of words that a worker keeps at hand
MOST_FIT = 20_000  # labelled rows of either class that the two curves are fitted to
KNOWN_LABELS = 2_000_000  # labels that are broadcast, 32 MB; more are joined by a shuffle


@dataclass
class Model:
    """Word scores, the decay and factor of the extreme-value law, and the logistic curve.

    A beginning of words ends in ``-`` among the scores.
    """

    scores: dict[str, float]
    decay: float
    factor: float
    weight: float
    offset: float
    _seen: dict[str, float | None] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_seen": {}}

    def _word(self, word: str) -> float | None:
        found = self.scores.get(word)
        for n in reversed(STEMS):
            if found is not None:
                break
            if n < len(word):
                found = self.scores.get(word[:n] + "-")
        return found

    def values(self, words: list[str]) -> list[float | None]:
        """The words' scores; a bounded number is kept for the next call."""
        seen = self._seen
        if len(seen) > SEEN_WORDS:
            seen.clear()
        out = []
        for word in words:
            try:
                out.append(seen[word])
            except KeyError:
                seen[word] = value = self._word(word)
                out.append(value)
        return out

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        return maximal_segments(self.values(words))

    def strength(self, words: list[str]) -> tuple[float, list[tuple[int, int, float]]]:
        """What significant segments exceed chance by, and the segments: start, end, score."""
        segments = self.segments(words)
        limit = math.log(max(self.factor * max(len(words), 1), 1e-12))
        found = [(a, b, s) for a, b, s in segments if self.decay * s > limit]
        return sum(self.decay * s - max(limit, 0.0) for _, _, s in found), found

    def probability(self, strength: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.offset + self.weight * strength))))


def maximal_segments(scores: list[float | None]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments in one pass, as ``start, end, score``.

    Words without a score cost ``DRIFT``; only scored words are visited. Kept
    candidates hold the sums before and after them and point past those to their
    left that can't matter; a new one joins to the left while that raises it.
    """
    # start, end, sum before, sum after, place of the nearest one to the left with less before
    kept: list[tuple[int, int, float, float, int]] = []
    total, last = 0.0, 0
    for at, score in enumerate(scores):
        if score is None:
            continue
        total -= DRIFT * (at - last)
        last = at + 1
        if score <= 0:
            total += score
            continue
        start, before = at, total
        total += score
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= before:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= total:
                break
            joined = j
            start, before, j = kept[joined][0], kept[joined][2], kept[joined][4]
            del kept[joined:]
        kept.append((start, at + 1, before, total, j))
    return [(a, b, after - before) for a, b, before, after, _ in kept]


def word_classes(labelled: DataFrame) -> DataFrame:
    """``word, toxic, clean``: texts of each class that use a word, or beginning, over all rows."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(letter_words(text))
                words.update([w[:n] + "-" for w in words for n in STEMS if n < len(w)])
                for word in words:
                    own = counts.get(word)
                    if own is None:
                        own = counts[word] = [0, 0]
                    own[toxic] += 1
            yield pa.record_batch(
                [
                    pa.array(list(counts), pa.string()),
                    pa.array([c[1] for c in counts.values()], pa.int64()),
                    pa.array([c[0] for c in counts.values()], pa.int64()),
                ],
                names=["word", "toxic", "clean"],
            )

    parts = labelled.select("text", "toxic").mapInArrow(task, "word string, toxic bigint, clean bigint")
    return parts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def word_scores(classes: DataFrame) -> tuple[dict[str, float], float]:
    """Log-odds under a Dirichlet prior less the drift, of words that tell the classes apart.

    The prior is the words' own distribution over both classes, worth
    ``PRIOR_USES``, and ``PRIOR_EACH`` of every word. Also returns the decay
    ``d`` with mean ``exp(d * score)`` of 1 over clean uses.
    """
    sums = classes.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"), F.count("*").alias("n")).first()
    toxic, clean = float(sums["t"] or 0), float(sums["c"] or 0)
    if not toxic or not clean:
        return {}, 1.0
    prior = (F.col("toxic") + F.col("clean")) / (toxic + clean) * PRIOR_USES + PRIOR_EACH
    t, c = F.col("toxic") + prior, F.col("clean") + prior
    whole = PRIOR_USES + PRIOR_EACH * float(sums["n"])
    odds = F.log(t / (toxic + whole - t)) - F.log(c / (clean + whole - c))
    z = odds / F.sqrt(1 / t + 1 / c)
    sure = stage(
        classes.select("word", "clean", odds.alias("odds"), z.alias("z")).where(F.abs("z") >= LEAST_Z), "toxicity-sure"
    )
    if (n := sure.count()) > MOST_WORDS:
        raise ValueError(f"{n} words tell the classes apart, at most {MOST_WORDS} can be held: raise LEAST_Z")
    kept = sorted(sure.select("word", "clean", "odds").collect())
    scores = {r["word"]: r["odds"] - DRIFT for r in kept}
    uses = np.array([r["clean"] + PRIOR_EACH for r in kept], float)
    share = np.array([*uses, max(clean - uses.sum(), clean / 2)]) / clean
    value = np.array([*scores.values(), -DRIFT])
    if not scores or value.max() <= 0 or (share * value).sum() >= 0:
        return scores, 1.0
    low, high = 0.0, 1.0
    while (share * np.exp(high * value)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if (share * np.exp(middle * value)).sum() > 1 else (middle, high)
    return scores, max(high, 1e-3)


def train(labelled: DataFrame) -> Model:
    """A model of ``text, toxic`` (0 or 1); other labels and null texts are left out.

    Word uses are counted over all labelled rows. The extreme-value factor and
    the logistic curve are fitted to at most ``MOST_FIT`` rows of each class,
    the first by a hash of the text. Without rows of both classes nothing can
    be told apart, and every text scores below the threshold.
    """
    rows = stage(
        columns(labelled, text="string", toxic="int").where("text IS NOT NULL AND toxic IN (0, 1)"), "toxicity-rows"
    )
    scores, decay = word_scores(stage(word_classes(rows), "toxicity-words"))
    plain = Model(scores, decay, 1.0, 0.0, -30.0)
    if not any(s > 0 for s in scores.values()):
        return plain
    shared = rows.sparkSession.sparkContext.broadcast(plain)

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, "text"):
            words = [letter_words(t) for t in batch.column(0).to_pylist()]
            parts = [[s for _, _, s in own.segments(w)] for w in words]
            yield pa.record_batch(
                [batch.column(1), pa.array([len(w) for w in words], pa.int64()), pa.array(parts, pa.list_(pa.float64())), batch.column(2)],
                names=["toxic", "n", "parts", "h"],
            )

    fit = stage(
        rows.select("text", "toxic", F.xxhash64("text").alias("h")).mapInArrow(
            best, "toxic int, n bigint, parts array<double>, h bigint"
        ),
        "toxicity-fit",
    )
    per_class = {r["toxic"]: r["count"] for r in fit.groupBy("toxic").count().collect()}
    chosen = [first_by_hash(fit.where(F.col("toxic") == k), "h", MOST_FIT, n) for k, n in sorted(per_class.items())]
    # a few numbers of a row reach the driver, however long its text is
    best_of = F.coalesce(F.array_max("parts"), F.lit(0.0))
    clean = chosen[0].select("hash", "n", best_of.alias("best")).collect()
    factor = extreme_factor([(r["n"], r["best"]) for r in sorted(clean)[:MOST_FIT]], decay)
    limit = F.log(F.greatest(F.lit(factor) * F.greatest("n", F.lit(1)), F.lit(1e-12)))
    over = F.filter("parts", lambda s: s * decay > limit)
    strength = F.aggregate(over, F.lit(0.0), lambda t, s: t + s * decay - F.greatest(limit, F.lit(0.0)))
    sample = []
    for rows_ in chosen:
        sample += sorted(rows_.select("hash", strength.alias("strength"), "toxic").collect())[:MOST_FIT]
    model = Model(scores, decay, factor, 0.0, 0.0)
    strengths = [r["strength"] for r in sample]
    model.weight, model.offset = logistic(np.array(strengths), np.array([r["toxic"] for r in sample], float))
    return model


def extreme_factor(best: list[tuple[int, float]], decay: float) -> float:
    """The factor K of ``P(best > x) = 1 - exp(-K n exp(-decay x))``, by maximum likelihood.

    With the decay given by the scores, ``K = texts / sum(n exp(-decay best))``;
    texts without any segment count as a best of 0.
    """
    total = sum(n * math.exp(-decay * x) for n, x in best)
    return len(best) / total if total > 0 else 1.0


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Weight (not negative) and offset by Newton's method, with a small ridge on the weight."""
    scale = max(float(x.std()), 1e-9)
    features = np.column_stack([x / scale, np.ones_like(x)])
    beta, ridge = np.zeros(2), np.diag([1e-3, 1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(features @ beta, -30, 30)))
        gradient = features.T @ (y - p) - ridge @ beta
        hessian = (features * (p * (1 - p))[:, None]).T @ features + ridge
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(beta[0] / scale), 0.0), float(beta[1])


THRESHOLD = 0.7


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted, segments, toxic_words`` of each row, from its whole text alone.

    ``predicted`` is 1 from a score of 0.7; ``segments`` has the significant
    passages as ``(start, end, score)`` in words (runs of letters, lower case).
    A null or empty text has no words and no segments and gets the score of
    such texts. Rows with equal or null ids are scored row by row; other
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, "text"):
            scores, segments = [], []
            for text in batch.column(1).to_pylist():
                strength, found = own.strength(letter_words(text))
                scores.append(own.probability(strength))
                segments.append([{"start": a, "end": b, "score": s} for a, b, s in found])
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()),
                    pa.array(segments, _SEGMENTS),
                ],
                names=["doc_id", "score", "predicted", "segments"],
            )

    return columns(docs, doc_id="bigint", text="string").mapInArrow(
        task, "doc_id bigint, score double, predicted int, segments array<struct<start:bigint,end:bigint,score:double>>"
    )


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that aren't predicted toxic, with all their columns.

    Null and empty texts have no words and stay unless the model takes that for toxic; equal
    rows are treated alike, and an empty table stays empty. Columns may have any names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, "text"):
            texts = batch.column(place).to_pylist()
            keep = [own.probability(own.strength(letter_words(t))[0]) < THRESHOLD for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(task, docs.schema)


_SEGMENTS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def learn_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts with a label, of the documents that may be learnt from.

    Ids that ``labels`` repeats with different labels are left out of neither
    side: each pair of a text and a label is a row.
    """
    known = columns(labels, doc_id="bigint", toxic="int").where("toxic IN (0, 1)").distinct()
    if labels.count() <= KNOWN_LABELS:
        known = F.broadcast(known)
    return columns(docs, doc_id="bigint", text="string").join(known, "doc_id").select("doc_id", "text", "toxic")
