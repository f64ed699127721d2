"""Tokens of two tokenizers over the same bytes: overlaps, groups, and how often ids go together.

Both tokenizers cut a text's bytes, so their tokens are two sorted lists of
ends. The merge of the two lists is split by merge path: on each diagonal, so
many ends further on, a binary search finds how many of them are of the first
list. The pieces hold equally many ends and are merged independently; each
emits its overlaps, and an end that both lists share closes a group also where
its two halves fall into neighbouring pieces.

How many documents hold a pair of ids is a statistic of the whole corpus. Pairs
are counted once per block of documents, a few megabytes of text, before
anything is shuffled, so a pair that all documents hold costs a row per block;
counts come back to the blocks the same way.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spokeworks.llm.batches import byte_of_character, columns, slices
from spokeworks.operators.staging import stage

PIECE = 1 << 16  # ends that a piece of a merge holds
BLOCK_ROWS, BLOCK_BYTES = 8192, 4 << 20
_CODES = 20_000  # pairs in one row of a block's list

#: Blocks of characters whose classes (letter, digit, mark, white space) are alike in every
#: Unicode version that the two libraries may carry.
_PLAIN = re.compile(
    "[\t\n\r -~¡-ɏ̀-̈́Α-ΡΣ-ώЀ-ҁҊ-ӿ‐-‧‰-⁞€ぁ-ゖァ-ヺー一-龥가-힣，。！？：；、「」]*"
)


class _Side:
    """One tokenizer: ids of texts, and the bytes of each id."""

    def __init__(self, token_bytes: list[bytes]):
        self.bytes = token_bytes
        self.lengths = np.array([len(b) for b in token_bytes], np.int64)
        self.size = len(token_bytes)

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


class ByteLevel(_Side):
    """Byte-level pairs from a vocabulary file; strings of special tokens are plain text.

    Ids are ranks of merges, so texts of plain characters go through the faster
    library with the same vocabulary; all others through the vocabulary's own.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        back = byte_of_character()
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        found = [b""] * self.tokenizer.get_vocab_size()
        ranks = {}
        for token, i in vocabulary.items():
            if token in special:
                found[i] = token.encode()
            else:
                found[i] = bytes(back[c] for c in token)
                ranks[found[i]] = i
        super().__init__(found)
        self.fast = tiktoken.Encoding(
            "byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(self._ids(" " + t), np.int64) for t in texts]

    def _ids(self, text: str):
        if _PLAIN.fullmatch(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class Pieces(_Side):
    """Pieces with byte fallback; the model itself puts a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                found.append(bytes([int(piece[3:5], 16)]))
            else:
                found.append(piece.replace("▁", " ").encode())
        super().__init__(found)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)]


@lru_cache(maxsize=1)
def sides(byte_level: str, pieces: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(byte_level), Pieces(pieces)


def split_merge(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of ``a`` and of ``b`` are among the first 0, ``size``, 2 ``size`` ... of their merge.

    Both are sorted; of equal values that of ``a`` comes first. All diagonals are
    searched at once.
    """
    total = len(a) + len(b)
    diagonal = np.append(np.arange(0, total, size), total)
    low, high = np.maximum(0, diagonal - len(b)), np.minimum(diagonal, len(a))
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_]) >> 1
        before = a[middle] <= b[diagonal[open_] - middle - 1]
        low[open_[before]] = middle[before] + 1
        high[open_[~before]] = middle[~before]
    return low, diagonal - low


def overlaps(a: np.ndarray, b: np.ndarray, size: int = PIECE) -> tuple[np.ndarray, ...]:
    """Overlapping tokens as places in ``a`` and ``b``, and the last tokens of each group.

    Each end, of the two that groups share only the first, ends one stretch of
    bytes that one token of either side covers: so a pair occurs once.
    """
    i, j = split_merge(a, b, size)
    of_a, of_b, last_a, last_b = [], [], [], []
    for i0, i1, j0, j1 in zip(i[:-1], i[1:], j[:-1], j[1:], strict=True):
        own_a, own_b = a[i0:i1], b[j0:j1]
        at_b = i0 + np.searchsorted(own_a, own_b, side="right")
        shared = np.zeros(len(own_b), bool)
        inside = at_b > 0
        shared[inside] = a[at_b[inside] - 1] == own_b[inside]  # the other half may end the piece before
        place_b = np.arange(j0, j1)
        of_a += [np.arange(i0, i1), at_b[~shared]]
        of_b += [j0 + np.searchsorted(own_b, own_a, side="left"), place_b[~shared]]
        last_a.append(at_b[shared] - 1)
        last_b.append(place_b[shared])
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (of_a, of_b, last_a, last_b))


@lru_cache(maxsize=4)
def _digits(size: int) -> np.ndarray:
    """The decimal digits of all numbers below ``size``, with zero bytes before them."""
    width = len(str(size - 1))
    tens = 10 ** np.arange(width - 1, -1, -1)
    numbers = np.arange(size)[:, None]
    digits = (numbers // tens % 10 + ord("0")).astype(np.uint8)
    digits[:, :-1][(numbers < tens)[:, :-1]] = 0
    return digits


def group_hashes(
    ids: tuple[np.ndarray, np.ndarray], docs: tuple[np.ndarray, np.ndarray], last: tuple[np.ndarray, np.ndarray], size: int, n: int
) -> list[str]:
    """Of each of ``n`` documents the hash of its groups, written as ``a1,a2|b1;a3|b2,b3``."""
    group = [np.searchsorted(x, np.arange(len(own)), side="left") for x, own in zip(last, ids, strict=True)]
    key = np.concatenate([2 * group[0], 2 * group[1] + 1])
    order = np.argsort(key, kind="stable")  # two sorted runs
    key, doc = key[order], np.concatenate(docs)[order]
    separator = np.full(len(key), ord(","), np.uint8)
    change = key[1:] != key[:-1]
    separator[:-1][change] = np.where(key[:-1][change] % 2, ord(";"), ord("|"))
    ends = np.searchsorted(doc, np.arange(n), side="right")
    begins = np.concatenate([[0], ends[:-1]])
    separator[ends[ends > begins] - 1] = 0
    written = np.column_stack([_digits(size)[np.concatenate(ids)[order]], separator])
    kept = written != 0
    flat = written[kept].tobytes()
    at = np.concatenate([[0], np.cumsum(kept.sum(axis=1))])
    return [
        hashlib.sha256(flat[at[x] : at[y]]).hexdigest() if y > x else ""
        for x, y in zip(begins.tolist(), ends.tolist(), strict=True)
    ]


def _packed(x: np.ndarray) -> bytes:
    planes = x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


_BLOCKS = (
    "block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string,"
    " places binary, times binary, codes array<bigint>, docs array<bigint>"
)
_ALIGNED = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint,"
    " groups_sha256 string"
)


def _block(texts: list[str | None], a: ByteLevel, b: Pieces, size: int = PIECE) -> tuple[list, np.ndarray, np.ndarray]:
    """Columns of a block's documents from ``n_a`` on, and its distinct pairs with their numbers of documents."""
    n = len(texts)
    given = [i for i, t in enumerate(texts) if t]
    ids_a, ids_b = ([np.empty(0, np.int64)] * n for _ in range(2))
    for i, x, y in zip(given, a.encode([texts[i] for i in given]), b.encode([texts[i] for i in given]), strict=True):
        raw = b" " + texts[i].encode()
        if a.joined(x) == raw and b.joined(y) == raw:
            ids_a[i], ids_b[i] = x, y
    n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
    doc_a, doc_b = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
    flat_a, flat_b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (ids_a, ids_b))
    # the documents' bytes lie behind each other, and each document ends a group
    of_a, of_b, last_a, last_b = overlaps(np.cumsum(a.lengths[flat_a]), np.cumsum(b.lengths[flat_b]), size)
    hashes = group_hashes((flat_a, flat_b), (doc_a, doc_b), (last_a, last_b), max(a.size, b.size), n)
    link_doc = doc_a[of_a]
    span = a.size * b.size
    key, times = np.unique(link_doc * span + flat_a[of_a] * b.size + flat_b[of_b], return_counts=True)
    codes, place, docs = np.unique(key % span, return_inverse=True, return_counts=True)
    bounds = np.searchsorted(key // span, np.arange(n + 1))
    places, often = [], []
    for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        places.append(_packed(np.diff(place[x:y], prepend=0)) if y > x else None)
        often.append(_packed(times[x:y]) if y > x else None)
    groups, links = np.bincount(doc_a[last_a], minlength=n), np.bincount(link_doc, minlength=n)
    return [n_a, n_b, groups, links, hashes, places, often], codes, docs


def _blocks(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """A row for each document with its pairs as places in its block's list, and rows with these lists."""
    types = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary()] + [pa.list_(pa.int64())] * 2
    names = [c.split()[0] for c in _BLOCKS.split(", ")]

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(byte_level, pieces)
        first = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(slices(batches, "text", BLOCK_ROWS, BLOCK_BYTES)):
            n = batch.num_rows
            own, codes, docs = _block(batch.column(1).to_pylist(), a, b)
            rows = [[first + number] * n, batch.column(0), *own, [None] * n, [None] * n]
            yield pa.record_batch([pa.array(x, t) if not isinstance(x, pa.Array) else x for x, t in zip(rows, types, strict=True)], names=names)
            for at in range(0, len(codes), _CODES):
                part = [[first + number], *([None] for _ in names[1:-2]), [codes[at : at + _CODES]], [docs[at : at + _CODES]]]
                yield pa.record_batch([pa.array(x, t) for x, t in zip(part, types, strict=True)], names=names)

    return columns(docs, doc_id="bigint", text="string").mapInArrow(task, _BLOCKS)


def _answered(docs: pa.Table, known: pa.Table) -> pa.Table:
    """``_ALIGNED`` of a block's documents, by the counts of its pairs."""
    order = np.argsort(known.column("code").to_numpy())
    count, best = (known.column(c).to_numpy()[order] for c in ("count", "best"))
    n_best, total = [], []
    for places, times in zip(docs.column("places").to_pylist(), docs.column("times").to_pylist(), strict=True):
        if places is None:
            n_best.append(0)
            total.append(0)
            continue
        at, often = np.cumsum(_unpacked(places)), _unpacked(times)
        n_best.append(int(often[best[at]].sum()))
        total.append(int((often * count[at]).sum()))
    out = docs.select([c.split()[0] for c in _ALIGNED.split(", ") if c.split()[0] not in ("n_best", "count_sum")])
    out = out.add_column(5, "n_best", pa.array(n_best, pa.int64()))
    return out.add_column(6, "count_sum", pa.array(total, pa.int64()))


def align(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every document.

    ``byte_level`` (A) encodes a space and the text, ``pieces`` (B) the text,
    before which it puts a space itself; neither adds special tokens. Groups end
    where tokens of both end; links are the pairs of tokens that share bytes. A
    pair of ids counts the documents of all rows that hold it linked: ``n_best``
    are the links whose pair has the highest count of its A id, ties included,
    and ``count_sum`` is the sum of the counts over all links.

    Texts that are null or empty, and those that either side doesn't give back
    byte by byte, have no tokens: zeros and an empty string. Every row is a
    document, also with an equal or null id and with an equal text. Other columns
    are ignored. An empty table gives no rows.
    """
    staged = stage(_blocks(docs, byte_level, pieces), "alignment-blocks")
    pairs = F.explode(F.arrays_zip("codes", "docs"))
    held = staged.where("codes IS NOT NULL").select("block", pairs.alias("p")).select("block", "p.codes", "p.docs")
    counts = stage(held.groupBy(F.col("codes").alias("code")).agg(F.sum("docs").alias("count")), "alignment-counts")
    size = sides(byte_level, pieces)[1].size
    counts = counts.withColumn("a", F.expr(f"code div {size}"))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    known = counts.join(most, "a").select("code", "count", (F.col("count") == F.col("most")).alias("best"))
    asked = held.select(F.col("block").alias("of_block"), F.col("codes").alias("code")).join(known, "code")
    own = staged.where("codes IS NULL").drop("codes", "docs")
    return own.groupBy("block").cogroup(asked.groupBy("of_block")).applyInArrow(_answered, _ALIGNED)
