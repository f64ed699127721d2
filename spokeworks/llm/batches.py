"""Small helpers for work inside tasks: bounded slices of Arrow batches, words, hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows worked on at once; texts vary, so a slice also ends at this many bytes.
SLICE_ROWS = 512
SLICE_BYTES = 4 << 20


def slices(
    batches: Iterable[pa.RecordBatch], column: str | None = None, rows: int = SLICE_ROWS, size: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of bounded rows and, by the text ``column``, bytes."""
    for batch in batches:
        if column is None:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < batch.num_rows:
            ends = np.cumsum(sizes[at : at + rows])
            n = max(1, int(np.searchsorted(ends, size, side="right")))
            yield batch.slice(at, n)
            at += n


def columns(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast; whatever else a table has is left behind."""
    return df.select(*(F.col(f"`{name}`").cast(kind).alias(name) for name, kind in types.items()))


def first_by_hash(df: DataFrame, key: str, most: int, rows: int) -> DataFrame:
    """About ``most`` of the ``rows`` of ``df``, and not fewer if there are so many: those first by a hash of ``key``.

    The bound is on the hash, by the counted rows, so no task sends more than its share;
    a caller that needs exactly ``most`` sorts what comes back by ``hash``.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << 32))
    marked = df.withColumn("hash", place)
    few = most + 6 * int(most**0.5) + 10  # more than most, but for one case in some billions
    return marked if rows <= few else marked.where(F.col("hash") < F.lit(few * (1 << 32) // rows))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with so many underscores before it that the table has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_words(text: str) -> list[bytes]:
    """Runs of anything but blank and \\x09-\\x0D, with A-Z (only) in lower case."""
    return text.encode().lower().split()


def byte_of_character() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for.

    Printable bytes stand for themselves, the others for the characters from 256 on.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal only for equal values, bits spread evenly."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(words: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)


_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str | None], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``hashes, bounds``: of each text the hashes of its distinct ``width``-word shingles, sorted.

    Those of text ``i`` are ``hashes[bounds[i] : bounds[i + 1]]``. With fewer words the whole
    sequence is the one shingle; without words there is none.
    """
    words = [ascii_words(t) if t else [] for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    hashed = word_hashes(chain.from_iterable(words))
    wide = np.minimum(counts, width)
    number = np.where(counts > 0, counts - wide + 1, 0)
    doc = np.repeat(np.arange(len(texts)), number)
    first = np.arange(len(doc)) - (np.cumsum(number) - number - np.cumsum(counts) + counts)[doc]
    own = wide[doc]
    total = np.zeros(len(doc), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            if (own > k).all():
                total = mixed(total + _STEP) + hashed[first + k]
            else:
                some = own > k
                total[some] = mixed(total[some] + _STEP) + hashed[first[some] + k]
        out = mixed(total + own.astype(np.uint64))
    ends = np.cumsum(number)
    for at, end in zip((ends - number).tolist(), ends.tolist(), strict=True):
        out[at:end].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(texts)))])


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """``shingle_sets`` of one text."""
    return shingle_sets([text], width)[0]
