"""Token counts by section: whole texts are encoded once, tokens go to sections by their place."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spokeworks.llm.batches import columns, slices

RULES = ("start", "end", "majority", "split")
SECTIONS = "array<struct<name:string,start:bigint,end:bigint>>"
RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("section", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("tokens", T.DoubleType()),
        T.StructField("crossing", T.LongType()),
    ]
)


@lru_cache(maxsize=2)
def _encoding(vocabulary: str):
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, rank in ranks.items():
        lengths[rank] = len(piece)
    encoding = tiktoken.Encoding(
        "vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    return encoding, lengths


def token_spans(text: str, vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token of the whole text.

    Tokens are byte strings: their lengths add up to byte offsets, and a byte
    belongs to the character it is part of. Tokens that share a character
    overlap in it.
    """
    encoding, lengths = _encoding(vocabulary)
    ends = np.cumsum(lengths[np.asarray(encoding.encode_ordinary(text), np.int64)])
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    raw = np.frombuffer(text.encode(), np.uint8)
    if len(raw) == len(text):
        return starts, ends
    seen = np.cumsum((raw & 0xC0) != 0x80)  # characters begun up to and with each byte
    return seen[starts] - 1, seen[ends - 1]


def line_sections(text: str) -> np.ndarray:
    """Bounds between lines; a line break belongs to the line that it ends."""
    breaks = [m.end() for m in re.finditer("\n", text)]
    if breaks and breaks[-1] == len(text):
        breaks.pop()
    return np.array([0, *breaks, len(text)], np.int64)


def allocate(
    first: np.ndarray, end: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str
) -> tuple[np.ndarray, np.ndarray, float]:
    """Tokens of each section, tokens that cross its bounds, and tokens of no section.

    Sections are sorted and don't overlap. Both sides are sorted, so the
    interval join is two binary searches per token.
    """
    n = len(starts)
    # the sections a token touches are lo..hi-1
    lo = np.searchsorted(ends, first, side="right")
    hi = np.searchsorted(starts, end, side="left")
    touched = np.maximum(hi - lo, 0)
    token = np.repeat(np.arange(len(first)), touched)
    place = np.arange(touched.sum()) - np.repeat(np.cumsum(touched) - touched, touched)
    section = lo[token] + place
    shared = np.minimum(end[token], ends[section]) - np.maximum(first[token], starts[section])
    crossing = np.bincount(section[shared < (end - first)[token]], minlength=n)
    if rule == "split":
        part = shared / (end - first)[token]
        return np.bincount(section, part, n), crossing, len(first) - float(part.sum())
    if rule == "start":
        keep = (starts[section] <= first[token]) & (first[token] < ends[section])
    elif rule == "end":
        keep = (starts[section] < end[token]) & (end[token] <= ends[section])
    else:  # the section with most of its characters, of equal ones the first
        order = np.lexsort((section, -shared, token))
        best = np.ones(len(order), bool)
        best[1:] = token[order][1:] != token[order][:-1]
        keep = np.zeros(len(order), bool)
        keep[order[best]] = True
    tokens = np.bincount(section[keep], minlength=n).astype(float)
    return tokens, crossing, float(len(first) - keep.sum())


def attribute_tokens(
    docs: DataFrame, vocabulary: str, rule: str = "start", sections: str | None = None
) -> DataFrame:
    """Tokens of each section of each document: ``doc_id, section, name, start, end, tokens, crossing``.

    ``vocabulary`` is the path of a file of byte-level ranks. Without
    ``sections`` the lines of a text are its sections; else it names a column of
    sorted, disjoint ``(name, start, end)`` in characters. A token that crosses
    a bound counts by ``rule``: for the section of its first or last character
    (``start``, ``end``), for the one that holds most of it (``majority``, the
    earlier one of equals), or in fractions (``split``). Tokens of no section
    are in a row with section -1, if there are any.

    A null or empty text is one section of no characters and no tokens; a null
    list of sections is an empty one. Rows with equal or null ids are counted
    row by row. Other columns are ignored. Every row stands alone, so nothing is
    shuffled and a lost task is simply run again.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}, known: {', '.join(RULES)}")
    wanted = columns(docs, doc_id="bigint", text="string")
    if sections is not None:
        wanted = docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.col("text").cast("string").alias("text"),
            F.col(f"`{sections}`").cast(SECTIONS).alias("sections"),
        )

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: list[list] = [[] for _ in RESULT.fields]
            given = batch.column("sections").to_pylist() if sections is not None else None
            for i, (doc, text) in enumerate(
                zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            ):
                text = text or ""
                if given is None:
                    bounds = line_sections(text)
                    starts, ends, names = bounds[:-1], bounds[1:], [None] * (len(bounds) - 1)
                else:
                    own = given[i] or []
                    starts = np.array([s["start"] for s in own], np.int64)
                    ends = np.array([s["end"] for s in own], np.int64)
                    names = [s["name"] for s in own]
                first, end = token_spans(text, vocabulary)
                tokens, crossing, rest = allocate(first, end, starts, ends, rule)
                number = list(range(len(starts)))
                parts = [number, names, starts.tolist(), ends.tolist(), tokens.tolist(), crossing.tolist()]
                if rest > 1e-9:
                    for part, value in zip(parts, (-1, None, None, None, rest, 0), strict=True):
                        part.append(value)
                out[0].extend([doc] * len(parts[0]))
                for column, part in zip(out[1:], parts, strict=True):
                    column.extend(part)
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(out, _ARROW, strict=True)], names=RESULT.names
            )

    return wanted.mapInArrow(task, RESULT)


_ARROW = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
