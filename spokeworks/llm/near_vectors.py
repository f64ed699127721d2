"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector is rotated at random and kept as the signs of its coordinates,
with the inner product of the vector and its signs as correction. Signs against
a rotated vector, over that correction, give an unbiased estimate of the inner
product of the two, with an error that is known in probability. Pairs are met
in buckets of equal short pieces of such codes, of several rotations; a pair
counts in the first bucket that both are in. Only pairs whose confidence bound
reaches the threshold are worked out exactly, on the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spokeworks.llm.components import components
from spokeworks.llm.vectors import matrix, usable, vectors
from spokeworks.operators.staging import stage

THRESHOLD = 0.95
MISSED = 1e-4  # chance that a pair just at the threshold shares no bucket
CONFIDENCE = 4.0  # standard errors of the estimate that a pair is given
BLOCK = 1024  # vectors of a larger bucket that meet another block
PAIRS = 200_000  # pairs worked on at once
SEED = 20240


@lru_cache(maxsize=8)
def rotations(width: int, bits: int) -> np.ndarray:
    """Random rotations side by side, at least ``bits`` columns; the same in every process."""
    draw = np.random.Generator(np.random.PCG64(SEED + width))
    out = []
    for _ in range(-(-bits // width)):
        q, r = np.linalg.qr(draw.standard_normal((width, width)))
        out.append(q * np.sign(np.diag(r)))
    return np.hstack(out)


def tables(rows: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Bits of a bucket's piece of code, and pieces: buckets of unrelated vectors stay small as rows grow."""
    bits = min(30, max(8, round(math.log2(max(rows, 2))) - 3))
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISSED) / math.log(1 - together))


def codes(classes: DataFrame, bits: int, pieces: int) -> DataFrame:
    """``vec_id, weight, vec, width, signs, correction, keys`` of unit-length codes of each vector."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = np.asarray(batch.column("vec").value_lengths())
            for w in np.unique(width):
                own = batch.filter(pa.array(width == w))
                vec = matrix(own.column("vec"), w)
                unit = vec / np.linalg.norm(vec, axis=1)[:, None]
                turned = unit @ rotations(int(w), max(int(w), bits * pieces))
                signs = turned[:, :w] > 0
                correction = np.abs(turned[:, :w]).sum(axis=1) / math.sqrt(w)
                places = (turned[:, : bits * pieces] > 0).reshape(len(vec), pieces, bits)
                keys = (places * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)
                yield pa.record_batch(
                    [
                        own.column("vec_id"),
                        own.column("weight"),
                        own.column("vec"),
                        pa.array(np.full(len(vec), w, np.int32)),
                        pa.array([x.tobytes() for x in np.packbits(signs, axis=1)], pa.binary()),
                        pa.array(correction),
                        pa.array(list(keys), pa.list_(pa.int32())),
                    ],
                    names=["vec_id", "weight", "vec", "width", "signs", "correction", "keys"],
                )

    return classes.mapInArrow(
        task,
        "vec_id bigint, weight bigint, vec array<double>, width int, signs binary, correction double, keys array<int>",
    )


class _Forest:
    """Links that join what no earlier link of the task has joined."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def _root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(up, up)
            x = up
        return x

    def joining(self, a: list[int], b: list[int]) -> Iterator[tuple[int, int]]:
        for x, y in zip(a, b, strict=True):
            u, v = self._root(x), self._root(y)
            if u != v:
                self.parent[max(u, v)] = min(u, v)
                yield x, y


def _run_pairs(lengths: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs within runs, in bounded portions."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    first = starts[row] + at
    after = lengths[row] - at - 1  # partners that follow in the run
    upto = np.cumsum(after)
    lo = 0
    while lo < len(first):
        done = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, done + PAIRS, side="right")))
        n = after[lo:hi]
        a = np.repeat(first[lo:hi], n)
        b = a + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield a, b
        lo = hi


def _links(rows: DataFrame, threshold: float, pieces: int) -> DataFrame:
    """``vec_id, other, links``: links counted by vector, and (with ``other``) links that join components."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        carried: pa.Table | None = None
        for batch in _with_end(batches):
            if batch is None:
                table, carried = carried, None
            else:
                table = pa.Table.from_batches([batch])
                if carried is not None:
                    table = pa.concat_tables([carried, table])
            if table is None or not table.num_rows:
                continue
            names = ("piece", "key", "width", "low", "high")
            group = np.column_stack([table.column(c).to_numpy() for c in names])
            starts = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]).any(axis=1)]))
            if batch is not None:  # the last run may go on
                carried = table.slice(starts[-1])
                table, group, starts = table.slice(0, starts[-1]), group[: starts[-1]], starts[:-1]
            if not len(starts):
                continue
            lengths = np.diff(np.append(starts, len(group)))
            ids, weight = (table.column(c).to_numpy() for c in ("vec_id", "weight"))
            block, correction = (table.column(c).to_numpy() for c in ("block", "correction"))
            keys = matrix(table.column("keys").combine_chunks(), pieces)
            for w in np.unique(group[:, 2]):
                some = (lengths > 1) & (group[starts, 2] == w)
                if not some.any():
                    continue
                own = np.flatnonzero(group[:, 2] == w)
                place = np.full(len(group), -1)
                place[own] = np.arange(len(own))
                vec = matrix(table.column("vec").combine_chunks().take(pa.array(own)), w)
                length = np.linalg.norm(vec, axis=1)
                turned = (vec / length[:, None]) @ rotations(int(w), int(w))
                raw = np.frombuffer(b"".join(table.column("signs").combine_chunks().take(pa.array(own)).to_pylist()), np.uint8)
                signs = np.unpackbits(raw.reshape(len(own), -1), axis=1, count=int(w)).astype(np.float32) * 2 - 1
                scale = 1 / (math.sqrt(w) * correction[own])
                error = CONFIDENCE * np.sqrt(np.maximum(1 - correction[own] ** 2, 0)) / correction[own] / math.sqrt(max(w - 1, 1e-12))
                for a, b in _run_pairs(lengths[some], starts[some]):
                    # blocks of a split bucket meet each other; each block meets itself once
                    keep = (block[a] != block[b]) | (group[a, 3] == group[a, 4])
                    keep &= ids[a] != ids[b]
                    a, b = a[keep], b[keep]
                    # the first piece that both share is this one
                    same = keys[a] == keys[b]
                    keep = same.argmax(axis=1) == group[a, 0]
                    a, b = a[keep], b[keep]
                    i, j = place[a], place[b]
                    estimate = np.einsum("ij,ij->i", signs[i], turned[j].astype(np.float32)) * scale[i]
                    keep = estimate + error[i] + 1e-5 >= threshold
                    a, b, i, j = a[keep], b[keep], i[keep], j[keep]
                    exact = np.einsum("ij,ij->i", vec[i], vec[j]) / (length[i] * length[j])
                    keep = exact >= threshold
                    a, b = a[keep], b[keep]
                    if not len(a):
                        continue
                    node, at = np.unique(np.concatenate([ids[a], ids[b]]), return_inverse=True)
                    n = np.bincount(at, np.concatenate([weight[b], weight[a]])).astype(np.int64)
                    yield _result(node, None, n)
                    joined = list(forest.joining(ids[a].tolist(), ids[b].tolist()))
                    if joined:
                        x, y = np.array(joined, np.int64).T
                        yield _result(x, y, np.zeros(len(x), np.int64))

    return rows.mapInArrow(task, "vec_id bigint, other bigint, links bigint")


def _result(ids, other, links) -> pa.RecordBatch:
    other = pa.nulls(len(ids), pa.int64()) if other is None else pa.array(other)
    return pa.record_batch([pa.array(ids), other, pa.array(links)], names=["vec_id", "other", "links"])


def _with_end(batches):
    yield from batches
    yield None


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row of ``vec_id, embedding``.

    Links are pairs with a cosine, in double precision, of the threshold or
    more; a pair just at it is missed with a chance of 1e-4, a nearer one more
    rarely, and no other pair links. ``n_links`` counts other rows;
    ``component_id`` is the smallest id reachable, the own included; ``kept``
    marks it. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing, and so do vectors of different lengths with
    each other. A row without an id has no links and no component and isn't
    kept. Rows that share an id are one node, which has the links of all. Other
    columns are ignored; an empty table stays empty.

    Equal vectors are one class before anything is compared. Buckets of more
    than ``BLOCK`` vectors are dealt into blocks that meet in pairs of blocks,
    so no task holds a whole bucket; pairs exist inside a task only.
    """
    every = vectors(df)
    valid = stage(every.where(F.col("vec_id").isNotNull() & usable(F.col("vec"))), "vectors")
    classes = stage(
        valid.groupBy("vec").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight")).select("vec_id", "weight", "vec"),
        "vector-classes",
    )
    bits, pieces = tables(classes.count(), threshold)
    coded = stage(codes(classes, bits, pieces), "vector-codes")
    spread = coded.select("*", F.posexplode("keys").alias("piece", "key"))
    full = (
        coded.select("width", F.posexplode("keys").alias("piece", "key"))
        .groupBy("width", "piece", "key")
        .count()
        .where(F.col("count") > BLOCK)
        .withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int"))
        .drop("count")
    )
    dealt = (
        spread.join(full, ["width", "piece", "key"], "left")
        .withColumn("block", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
    )
    group = ("piece", "key", "width", "low", "high")
    ordered = (
        dealt.select(*group, "block", "vec_id", "weight", "vec", "signs", "correction", "keys")
        .repartition(*group)
        .sortWithinPartitions(*group)
    )
    found = stage(_links(ordered, threshold, pieces), "vector-links")
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("links")).withColumnRenamed("vec_id", "first")
    parts = components(found.where("other IS NOT NULL").select(F.col("vec_id").alias("a"), F.col("other").alias("b")))
    firsts = classes.withColumnRenamed("vec_id", "first")
    own = (
        valid.join(firsts, "vec")
        .select("vec_id", "first", "weight")
        .join(counts, "first", "left")
        .join(parts.select(F.col("node").alias("first"), "component"), "first", "left")
        .groupBy("vec_id")
        .agg(
            F.max(F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.min(F.coalesce("component", "first")).alias("component"),
        )
    )
    component = F.coalesce("component", "vec_id")
    return every.select("vec_id").join(own, "vec_id", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
