"""Documents packed into token sequences of bounded length by bulk best fit.

Lengths are whole numbers up to the bound, so documents of one length, and
gaps of one size, are ranks of one class. The classes, never more than the
bound's number, are range-sorted and matched: the longest documents go to
their successor, the smallest gap that holds them; of documents that want the
same gaps the first by rank get them; gaps are updated; the rest sweeps on to
the next gap. Only counts by length reach the driver. What comes back is a
table of rank ranges by length, by which tasks place their own documents.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spokeworks.llm.batches import byte_of_character, columns, slices
from spokeworks.operators.staging import stage

END = 1  # the id that ends a document
SIZE = 4096
_ROWS_PER_BUCKET = 20_000
_PLAIN = re.compile("[!-~¡-ɏ]+")  # assigned, without white space, alike in every Unicode version


class _Runs(dict):
    """Ids, as little-endian bytes, of runs of letters, of digits or of other characters.

    Merges of the vocabulary have its ids in their order, and a run's last character is
    marked. The mark is the byte 255, which no text holds: with it ids are ranks of byte
    strings, and the faster library merges a run.
    """

    MOST, LONGEST = 300_000, 64

    def __init__(self, path: str):
        import json

        import tiktoken

        back = byte_of_character()
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        ranks = {}
        for token, i in vocabulary.items():
            if not token.startswith("<|"):
                plain, mark = (token[:-4], b"\xff") if token.endswith("</w>") else (token, b"")
                ranks[bytes(back[c] for c in plain) + mark] = i
        self.merge = tiktoken.Encoding("runs", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, run: str) -> bytes:
        raw = run.encode()
        found = np.array(self.merge(raw + b"\xff"), "<u4").tobytes()
        if len(raw) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[run] = found
        return found


class _Words(dict):
    """Ids, as little-endian bytes, of a text's pieces between white space.

    Neither normalisation nor splitting looks across white space, and ids don't
    depend on the neighbours, so a piece always has the same ids. Pieces in a
    plain script are split here, by the vocabulary's own pattern, and runs are
    merged once; all others, and those that may hold a special token, go
    through the whole tokenizer. A bounded number is kept.
    """

    MOST, LONGEST = 400_000, 64

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.runs = _Runs(path)
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall

    def __missing__(self, piece: bytes) -> bytes:
        text = piece.decode()
        if text.isascii() and text.isalpha():
            found = self.runs[text.lower()]
        elif _PLAIN.fullmatch(text) and "<|" not in text:
            plain = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()
            found = b"".join([self.runs[run] for run in self.split(plain)])
        else:
            found = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(piece) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[piece] = found
        return found


@lru_cache(maxsize=1)
def _words(path: str) -> _Words:
    return _Words(path)


def token_bytes(text: str | None, path: str) -> bytes:
    """The ids of a whole text and the end id, each as four little-endian bytes."""
    words = _words(path)
    return b"".join([words[w] for w in (text or "").encode().split()]) + END.to_bytes(4, "little")


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each document's pieces, with ``ids`` if asked.

    A document is its ids and the end id; only one longer than ``size`` is cut,
    into pieces of ``size`` and a last one. Null text is empty text.
    """
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * ids

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            doc, piece, start, length, crc, tokens = [], [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = token_bytes(text, tokenizer)
                for k, at in enumerate(range(0, len(raw), 4 * size)):
                    part = raw[at : at + 4 * size]
                    doc.append(key)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if ids:
                        tokens.append(np.frombuffer(part, "<i4"))
            arrays = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32())]
            arrays += [pa.array(x, pa.int64()) for x in (start, length, crc)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if ids:
                arrays.append(pa.array(tokens, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.record_batch(arrays, names=names)

    return columns(docs, doc_id="bigint", text="string").mapInArrow(task, schema)


def best_fit(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Where ranks of each length go: ``length, first rank, end rank, first sequence, offset``.

    Rank ``r`` of a row goes to the row's sequence plus ``r`` less its first
    rank. One round for each length, the longest first; within a round gaps are
    swept from the smallest that holds the length.
    """
    ranges: dict[int, list[tuple[int, int]]] = {}  # sequences by the size of their gap
    open_gaps = np.zeros(size + 1, bool)
    placed, sequences = [], 0

    def add(gap: int, first: int, end: int) -> None:
        if gap and first < end:
            ranges.setdefault(gap, []).append((first, end))
            open_gaps[gap] = True

    for length in sorted(counts, reverse=True):
        rank, total = 0, counts[length]
        while rank < total:
            fits = np.flatnonzero(open_gaps[length:])
            if len(fits):
                gap = length + int(fits[0])
            else:
                gap, more = size, -(-(total - rank) // (size // length))
                add(gap, sequences, sequences + more)
                sequences += more
            own = ranges.pop(gap)
            open_gaps[gap] = False
            for first, end in own:
                n = min(end - first, total - rank)
                if n:
                    placed.append((length, rank, rank + n, first, size - gap))
                    add(gap - length, first, first + n)
                    rank += n
                add(gap, first + n, end)
    return placed


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: few sequences of at most ``size`` tokens.

    Every row is placed, also rows with equal or null ids; rows of equal length
    are ranked by id, piece and checksum, and rows equal in all of these are
    interchangeable. Offsets of a sequence follow without gaps from 0. An empty
    table stays empty. Lengths must lie from 1 to ``size``.

    Ranks are made of two parts, so that a length that many rows have is spread:
    rows before a row's bucket, and its place in the bucket, where the number of
    buckets grows with the rows.
    """
    spark = cut.sparkSession
    staged = stage(cut, "pieces")
    counts = {r["length"]: r["count"] for r in staged.groupBy("length").count().collect()}
    table = sorted(best_fit(counts, size))
    buckets = max(1, -(-sum(counts.values()) // _ROWS_PER_BUCKET))
    bucketed = staged.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy("length", "_b")
        .count()
        .select("length", "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    )
    within = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")
    ranked = bucketed.join(offsets, ["length", "_b"]).withColumn(
        "_rank", F.col("_before") + F.row_number().over(within) - 1
    )
    # as large as the number of lengths allows, whatever the number of rows
    shared = spark.sparkContext.broadcast(np.array(table, np.int64).reshape(-1, 5))
    kept = [c for c in staged.columns]
    schema = staged.select(*kept).withColumns({"sequence_id": F.lit(0).cast("bigint"), "offset": F.lit(0).cast("bigint")}).schema

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, first, _, sequence, offset = shared.value.T
        bounds = np.searchsorted(lengths, np.arange(size + 2))
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            row = np.zeros(len(length), np.int64)
            for n in np.unique(length):
                own = length == n
                lo, hi = bounds[n], bounds[n + 1]
                row[own] = lo + np.searchsorted(first[lo:hi], rank[own], side="right") - 1
            out = [batch.column(c) for c in kept]
            out += [pa.array(sequence[row] + rank - first[row]), pa.array(offset[row])]
            yield pa.record_batch(out, names=[*kept, "sequence_id", "offset"])

    return ranked.select(*kept, "_rank").mapInArrow(task, schema)


def sequences(placed: DataFrame) -> DataFrame:
    """``sequence_id, doc_ids, ids`` of packed pieces that carry their ids, in order of offset."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return (
        placed.groupBy("sequence_id")
        .agg(parts.alias("parts"))
        .select(
            "sequence_id",
            F.col("parts.doc_id").alias("doc_ids"),
            F.flatten(F.col("parts.ids")).alias("ids"),
        )
    )
