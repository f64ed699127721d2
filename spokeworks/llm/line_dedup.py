"""Repeated runs of lines, found by prefix doubling over line ids; later copies are deleted.

A document is the sequence of the ids of its lines that have words. Doubling
gives every place the class of the 1, 2, 4, ... lines from there: two places
have equal classes exactly if the suffixes from there share that many lines. A
window of any length is known by the two classes, of the largest power of two
within it, that cover it from both ends. Places whose windows are equal form
an interval of the suffix array with at least that common prefix. Ids are
64-bit hashes, and so are the classes: only their equality matters, so they
need no global ranks, and doubling stays inside a document's row.

A run repeats when it has at least ``min_words`` words and occurs before, in
order of document and line. It is enough to look at its shortest windows with
so many words, from each line on and up to each line: every line of the run is
in one of them. Overlapping windows that occur before join to maximal runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spokeworks.llm.batches import unused
from spokeworks.operators.staging import stage

MIN_WORDS = 50
KNOWN_RUNS = 1_000_000  # runs that are broadcast, some 40 MB; more are joined by a shuffle


def _sequence(text: Column) -> Column:
    """``no, id, words`` of the lines that have words, in order."""
    lines = F.transform(
        F.split(text, "\n", -1),
        lambda line, no: F.struct(
            no.alias("no"),
            F.xxhash64(line).alias("id"),
            F.regexp_count(line, F.lit(r"\S+")).alias("words"),
        ),
    )
    return F.filter(lines, lambda x: x["words"] > 0)


def _doubled(rows: DataFrame, rounds: int) -> DataFrame:
    """Adds ``class0..`` and ``sum0..``: class and words of the 1, 2, 4, ... lines from each place.

    Past the end of a document the class is null and the words are too many to
    be added to any window.
    """
    rows = rows.withColumns(
        {
            "class0": F.transform("lines", lambda x: x["id"]),
            "sum0": F.transform("lines", lambda x: x["words"].cast("bigint")),
        }
    )
    for k in range(rounds):
        half = 1 << k
        rows = rows.withColumns(
            {
                f"class{k + 1}": _joined(f"class{k}", half, lambda one, other: F.xxhash64(one, other)),
                f"sum{k + 1}": _joined(f"sum{k}", half, lambda one, other: one + other),
            }
        )
    return rows


def _joined(name: str, half: int, both) -> Column:
    """What a place and the one ``half`` lines on have, joined; null past the end."""
    return F.transform(
        name, lambda one, i: F.when(i + 2 * half <= F.col("n"), both(one, F.get(F.col(name), i + half)))
    )


def _length(i: Column, rounds: int, min_words: int, backward: bool) -> Column:
    """Lines of the shortest window with enough words from line ``i`` on, or up to it.

    By halving steps: go on over 2^k lines as long as these still leave too few.
    """
    steps = F.array(*(F.struct(F.lit(1 << k).alias("step"), F.lit(k).alias("k")) for k in range(rounds, -1, -1)))
    sums = F.array(*(F.col(f"sum{k}") for k in range(rounds + 1)))

    def go(state: Column, step: Column) -> Column:
        at = i - state["n"] - step["step"] + 1 if backward else i + state["n"]
        more = state["words"] + F.when(at >= 0, F.get(F.get(sums, step["k"]), at))
        taken = F.coalesce(more < min_words, F.lit(False))
        return F.struct(
            (state["n"] + F.when(taken, step["step"]).otherwise(0)).alias("n"),
            F.when(taken, more).otherwise(state["words"]).alias("words"),
        )

    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("words"))
    return F.aggregate(steps, start, go, lambda state: state["n"] + 1)


def _window(first: Column, n: Column, rounds: int) -> Column:
    """``class, first, last, start, end`` of ``n`` lines from place ``first``; null past an end.

    ``first`` and ``last`` are places in the sequence, ``start`` and ``end`` line numbers.
    """
    found = F.lit(None).cast("bigint")
    for k in range(rounds, -1, -1):
        within = (n >= (1 << k)) & (n < (2 << k))
        both = F.xxhash64(n, F.get(F.col(f"class{k}"), first), F.get(F.col(f"class{k}"), first + n - (1 << k)))
        found = F.when(within, both).otherwise(found)
    lines = F.col("lines")
    inside = (first >= 0) & (first + n <= F.col("n"))
    return F.when(
        inside,
        F.struct(
            found.alias("class"),
            first.alias("first"),
            (first + n - 1).alias("last"),
            F.get(lines, first)["no"].alias("start"),
            F.get(lines, first + n - 1)["no"].alias("end"),
        ),
    )


def windows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, h, class, first, last, start, end``: shortest windows with enough words.

    From each line on, and up to each line.
    """
    rounds = max(0, (min_words - 1).bit_length())
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64(F.col("text").cast("string")).alias("h"),
        _sequence(F.col("text").cast("string")).alias("lines"),
    )
    rows = rows.withColumn("n", F.size("lines")).where(
        F.aggregate("lines", F.lit(0).cast("bigint"), lambda s, x: s + x["words"]) >= min_words
    )
    rows = _doubled(rows, rounds)
    places = F.sequence(F.lit(0), F.col("n") - 1)

    def forward(i: Column) -> Column:
        return F.struct(i.alias("first"), _length(i, rounds, min_words, False).alias("n"))

    def backward(i: Column) -> Column:
        n = _length(i, rounds, min_words, True)
        return F.struct((i + 1 - n).alias("first"), n.alias("n"))

    rows = rows.withColumn("spans", F.concat(F.transform(places, forward), F.transform(places, backward)))
    found = F.transform("spans", lambda s: _window(s["first"], s["n"], rounds))
    return (
        rows.select("doc_id", "h", F.explode(F.filter(found, lambda w: w.isNotNull())).alias("w"))
        .select("doc_id", "h", "w.*")
    )


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, h, start, end``: maximal runs of lines, by number from 0, that occur before.

    ``h`` is a hash of the text: rows with equal or null ids are told apart by
    it, and equal rows have equal runs. Runs that touch are one, with the lines
    without words in between.
    """
    found = stage(windows(docs, min_words), "line-windows")
    place = F.struct("doc_id", "h", "start")
    firsts = found.groupBy("class").agg(F.min(place).alias("before"), F.max(place).alias("after"))
    firsts = firsts.where("before < after").select("class", "before")
    later = found.join(firsts, "class").where(place > F.col("before")).drop("class", "before").distinct()
    order = Window.partitionBy("doc_id", "h").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce((F.col("first") > F.col("reach") + 1).cast("int"), F.lit(1))
    return (
        later.withColumn("reach", reach)
        .withColumn("run", F.sum(begins).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "h", "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .select("doc_id", "h", "start", "end")
    )


def count_names(docs: DataFrame) -> list[str]:
    """The names of the two columns that ``without_repeats`` adds."""
    return unused(docs, "_lines", "_removed")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with all their columns, without later copies of repeated runs.

    Adds ``_lines`` and ``_removed``, the lines of each text and those deleted, or what
    ``count_names`` gives where the table has such columns.
    The first occurrence, by id (null first), hash of the text and line, stays;
    occurrences may overlap, so of a run that repeats itself at once the first
    lines stay. Lines without words go when the lines with words around them
    both go. Null text has no lines and stays null; equal rows are
    one occurrence and are treated alike. An empty table stays empty.
    """
    lines_, removed_ = count_names(docs)
    id_, h, found_ = unused(docs, "_id", "_h", "_runs")
    runs = stage(
        repeated_runs(docs, min_words)
        .groupBy(F.col("doc_id").alias(id_), F.col("h").alias(h))
        .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(found_)),
        "line-runs",
    )
    if (runs.agg(F.sum(F.size(found_)).alias("n")).first()["n"] or 0) <= KNOWN_RUNS:
        runs = F.broadcast(runs)
    text = F.col("text").cast("string")
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(id_)) & (F.xxhash64(text) == F.col(h))
    every = F.split(text, "\n", -1)
    found = F.col(found_)

    def kept(i: Column) -> Column:
        start = F.when(i == 0, 0).otherwise(F.get(found, i - 1)["end"] + 1)
        end = F.when(i == F.size(found), F.size(every)).otherwise(F.get(found, i)["start"])
        return F.slice(every, start + 1, end - start)

    parts = F.flatten(F.transform(F.sequence(F.lit(0), F.size(found)), kept))
    removed = F.aggregate(found, F.lit(0), lambda s, r: s + r["end"] - r["start"] + 1)
    return docs.join(runs, same, "left").select(
        *(
            F.when(found.isNull(), text).otherwise(F.array_join(parts, "\n")).alias(c) if c == "text" else F.col(f"`{c}`")
            for c in docs.columns
        ),
        F.when(text.isNull(), 0).otherwise(F.size(every)).alias(lines_),
        F.coalesce(removed, F.lit(0)).alias(removed_),
    )
