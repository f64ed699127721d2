"""The exact best inner products of whole-number vectors, by length and by rotated partial sums.

Vectors are range-sorted by descending length and cut into blocks. Queries meet
the blocks in rounds, the longest vectors first. After each round the worst of a
query's best is a score that others have to reach: no vector shorter than that
score over the query's length can. Those that are left are summed in the axes of
the singular value decomposition, the strongest first; what the other axes
could add is bounded by the product of the lengths there (Cauchy-Schwarz). Only
pairs that pass get their exact whole-number product.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spokeworks.llm.vectors import matrix
from spokeworks.operators.staging import stage

SCALE = 1024
BLOCK = 2048  # vectors of a block
BLOCKS_PER_PART = 8  # blocks that one part of the order has, about
MOST_QUERIES = 4096  # queries that meet a block at once
GROWTH = 8  # times as many vectors in each round as in all before
_FITS = 2.0**62  # squared lengths below this keep all sums in 64 bits
_EXACT = 2.0**53  # sums below this are exact in doubles
_RESULT = "query_id bigint, rank int, vec_id bigint, score bigint"


def whole(df: DataFrame, id_: str, vector: str) -> DataFrame:
    """``vec_id, vec``, where ``vec`` has only components that are there and finite."""
    rows = df.select(
        F.col(f"`{id_}`").cast("bigint").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vec")
    )
    infinite = float("inf")
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))


def _quantised(vec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole-number vectors and squared lengths; rows too long for 64 bits have length infinity."""
    with np.errstate(over="ignore"):
        x = np.floor(vec * SCALE)
        long = (x * x).sum(axis=1)
    long[~(long < _FITS)] = np.inf
    x[np.isinf(long)] = 0
    return x, long


def quantised(rows: DataFrame, width: int) -> DataFrame:
    """``vec_id, vec, long``: vectors of ``width`` in whole numbers, with squared lengths."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, long = _quantised(matrix(batch.column("vec"), width))
            fits = np.flatnonzero(np.isfinite(long))
            flat = pa.array(x[fits].astype(np.int64).ravel())
            vec = pa.ListArray.from_arrays(pa.array(np.arange(len(fits) + 1, dtype=np.int32) * width), flat)
            yield pa.record_batch([batch.column("vec_id").take(pa.array(fits)), vec, pa.array(long[fits])], names=["vec_id", "vec", "long"])

    return rows.where(F.size("vec") == width).mapInArrow(task, "vec_id bigint, vec array<bigint>, long double")


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """The axes of all vectors' singular value decomposition as columns, the strongest first.

    Tasks sum up products of components, ``width`` by ``width`` numbers each;
    these sums are added by component, and only one such square reaches the driver.
    """

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = matrix(batch.column("vec"), width).astype(float)
            total += x.T @ x
        i, j = np.indices(total.shape)
        yield pa.record_batch([pa.array(x.ravel()) for x in (i.astype(np.int32), j.astype(np.int32), total)], names=["i", "j", "s"])

    sums = rows.select("vec").mapInArrow(task, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    square = np.zeros((width, width))
    for r in sums.collect():
        square[r["i"], r["j"]] = r["s"]
    return np.linalg.eigh(square / max(1.0, np.abs(square).max()))[1][:, ::-1].copy()


def _ordered_blocks(rows: DataFrame, parts: int, width: int) -> DataFrame:
    """``part, number, longest, ids, vecs``: vectors by descending length, in blocks."""
    ordered = rows.repartitionByRange(parts, F.col("long").desc(), "vec_id").sortWithinPartitions(
        F.col("long").desc(), "vec_id"
    )
    block = BLOCK

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                own = batch.slice(at, block)
                longest = float(np.sqrt(own.column("long").to_numpy().max()))
                ids = own.column("vec_id").to_numpy().tobytes()
                vecs = np.ascontiguousarray(matrix(own.column("vec"), width)).tobytes()
                row = [[part], [number], [longest], [ids], [vecs]]
                types = [pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary()]
                yield pa.record_batch([pa.array(x, t) for x, t in zip(row, types, strict=True)], names=["part", "number", "longest", "ids", "vecs"])
                number += 1

    return ordered.mapInArrow(task, "part int, number int, longest double, ids binary, vecs binary")


def best_of_block(
    q_ids: np.ndarray, q: np.ndarray, bound: np.ndarray, ids: np.ndarray, v: np.ndarray, axes: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Query places, vector places and scores of the best ``k`` that reach the bounds, and pairs computed exactly.

    Ties go to the smaller id; a query isn't its own neighbour.
    """
    width = q.shape[1]
    qf, vf = q.astype(float), v.astype(float)
    q_long, v_long = np.sqrt((qf * qf).sum(axis=1)), np.sqrt((vf * vf).sum(axis=1))
    exact = q_long.max(initial=0) * v_long.max(initial=0) < _EXACT
    rq, rv = qf @ axes, vf @ axes
    steps = sorted({max(1, width // 8), max(1, width // 2)} - {width})
    rest = [(np.sqrt((rq[:, m:] ** 2).sum(axis=1)), np.sqrt((rv[:, m:] ** 2).sum(axis=1))) for m in steps]
    out: list[list[np.ndarray]] = [[], [], []]
    computed = 0
    for at in range(0, len(q), 256):
        own = slice(at, min(at + 256, len(q)))
        least = bound[own, None]
        product = q_long[own, None] * v_long
        least = least - product * 1e-9  # what rounding may take from a sum
        alive = (product >= least) & (q_ids[own, None] != ids)
        for m, (q_rest, v_rest) in zip(steps, rest, strict=True):
            i, j = np.nonzero(alive)
            if 8 * len(i) > alive.size:  # most are left: sum up all
                alive &= rq[own, :m] @ rv[:, :m].T + q_rest[own, None] * v_rest >= least
            else:
                for part in range(0, len(i), 1 << 16):
                    x, y = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
                    most = np.einsum("ij,ij->i", rq[own][x, :m], rv[y, :m]) + q_rest[own][x] * v_rest[y]
                    alive[x, y] = most >= least[x, y]
        i, j = np.nonzero(alive)
        computed += len(i)
        if exact and 8 * len(i) > alive.size:
            scores = (qf[own] @ vf.T)[i, j].astype(np.int64)
        else:
            left, right = (qf[own], vf) if exact else (q[own], v)
            scores = np.concatenate(
                [np.empty(0, np.int64)]
                + [
                    np.einsum("ij,ij->i", left[i[p : p + (1 << 16)]], right[j[p : p + (1 << 16)]]).astype(np.int64)
                    for p in range(0, len(i), 1 << 16)
                ]
            )
        reach = scores >= bound[own][i]
        i, j, scores = i[reach], j[reach], scores[reach]
        order = np.lexsort((ids[j], -scores, i))
        i, j, scores = i[order], j[order], scores[order]
        begin = np.searchsorted(i, np.arange(own.stop - own.start))
        keep = np.arange(len(i)) - begin[i] < k
        for column, x in zip(out, (at + i[keep], j[keep], scores[keep]), strict=True):
            column.append(x)
    found = [np.concatenate(c) if c else np.empty(0, np.int64) for c in out]
    return found[0], found[1], found[2], computed


def _scored(pairs: DataFrame, axes: np.ndarray, k: int, width: int) -> DataFrame:
    """``query_id, vec_id, score`` of each pair of a block of queries with a block of vectors."""
    shared = pairs.sparkSession.sparkContext.broadcast(axes)  # width x width

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.slice(row, 1)
                q_ids = part.column("q_ids").flatten().to_numpy()
                q = matrix(part.column("q_vecs").flatten(), width)
                bound = part.column("q_bounds").flatten().to_numpy()
                ids = np.frombuffer(part.column("ids")[0].as_buffer(), np.int64)
                v = np.frombuffer(part.column("vecs")[0].as_buffer(), np.int64).reshape(-1, width)
                i, j, scores, _ = best_of_block(q_ids, q, bound, ids, v, shared.value, k)
                yield pa.record_batch([pa.array(q_ids[i]), pa.array(ids[j]), pa.array(scores)], names=["query_id", "vec_id", "score"])

    return pairs.select("q_ids", "q_vecs", "q_bounds", "ids", "vecs").mapInArrow(
        task, "query_id bigint, vec_id bigint, score bigint"
    )


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return scored.distinct().withColumn("rank", rank).where(F.col("rank") <= k)


def search(df: DataFrame, is_query, k: int = 10, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest scores of each query, highest first; exact.

    A component x counts as floor(1024 x); a score is the inner product of such
    whole numbers. Queries are the rows that ``is_query``, a condition on
    ``vec_id``, selects; candidates are all rows but those with the query's own
    id. Ties go to the smaller id; with fewer candidates all are returned.

    Rows without an id, and vectors that are null or hold null or non-finite
    components, take no part, nor do those of another length than most rows have,
    nor those whose squared length reaches 2^62, as scores are 64-bit numbers.
    Zero vectors take part. Rows that are repeated are one; an id with several
    vectors is a query and a candidate with each. Other columns are ignored; an
    empty table, or one without queries, gives no rows.

    Blocks of queries meet blocks of vectors: at first those of the longest
    ones, then in each round ``GROWTH`` times as many as before, of which a block of
    queries skips those too short for all of its bounds. A query's best are
    written after each round, so a lost executor costs one round at most.
    """
    spark = df.sparkSession
    valid = stage(whole(df, id_, vector).distinct(), "search-vectors")
    widths = valid.groupBy(F.size("vec").alias("w")).count().orderBy(F.col("count").desc(), F.col("w").desc()).first()
    if widths is None or not widths["w"]:
        return spark.createDataFrame([], _RESULT)
    width = widths["w"]
    rows = stage(quantised(valid, width).distinct(), "search-whole")
    axes = rotation(rows, width)
    parts = max(1, -(-widths["count"] // (BLOCK * BLOCKS_PER_PART)))
    blocks = stage(_ordered_blocks(rows, parts, width), "search-blocks")
    last = blocks.agg(F.max("part").alias("p")).first()["p"]
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "vec", F.sqrt("long").alias("length"))
    asked = queries.count()
    if not asked or last is None:
        return spark.createDataFrame([], _RESULT)
    # enough blocks of queries to keep the cores busy, then of MOST_QUERIES
    cores = 4 * spark.sparkContext.defaultParallelism
    dealt = max(-(-asked // MOST_QUERIES), min(cores, -(-asked // 32)))
    queries = queries.withColumn("q_block", F.pmod(F.xxhash64("query_id", "vec"), F.lit(dealt)))

    def met(found: DataFrame | None, low: int, high: int, heads: bool) -> DataFrame:
        """The pairs of blocks of a round: vectors of the parts ``low..high``, their first blocks or the others."""
        bounds = queries.withColumn("bound", F.lit(None).cast("bigint"))
        if found is not None:
            worst = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
            bounds = queries.join(worst, "query_id", "left")
        bounds = bounds.withColumn("bound", F.coalesce("bound", F.lit(-(1 << 63))))
        reach = F.when(F.col("bound") > 0, F.col("bound") / F.col("length") * (1 - 1e-9)).otherwise(0.0)
        each = F.collect_list(F.struct("query_id", "vec", "bound"))
        q = stage(bounds.groupBy("q_block").agg(each.alias("q"), F.min(reach).alias("reach")), "search-queries")
        own = blocks.where(F.col("part").between(low, high))
        if low == 0:
            own = own.where((F.col("number") == 0) if heads else (F.col("number") > 0))
        wanted = q.select("q_block", "reach", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("part"))
        pairs = wanted.join(own.select("part", "number", "longest"), "part").where(F.col("longest") >= F.col("reach"))
        with_vectors = pairs.select("q_block", "part", "number").join(own.drop("longest"), ["part", "number"])
        return with_vectors.join(
            q.select(
                "q_block",
                F.col("q.query_id").alias("q_ids"),
                F.col("q.vec").alias("q_vecs"),
                F.col("q.bound").alias("q_bounds"),
            ),
            "q_block",
        )

    found = None
    rounds = [(0, 0, True), (0, 0, False)]
    low = 1
    while low <= last:
        high = min(last, GROWTH * low - 1)
        rounds.append((low, high, False))
        low = high + 1
    for low, high, heads in rounds:
        scored = _scored(met(found, low, high, heads), axes, k, width)
        if found is not None:
            scored = scored.unionByName(found.drop("rank"))
        found = stage(_ranked(scored, k), "search-found")
    return found.select("query_id", "rank", "vec_id", "score")
