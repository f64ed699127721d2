"""Nearest vectors by inner product with a hierarchical k-means tree.

The tree is fitted to a bounded sample; every vector goes down it to a leaf. A
query walks the tree best bin first: a priority queue holds the nodes seen so
far, the most promising on top, and leaves are visited in the order in which
they come up. How many is calibrated: for some queries the exact neighbours are
found against all rows, and the visits are widened until these are reached.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spokeworks.llm.batches import first_by_hash
from spokeworks.llm.vectors import matrix, usable, vectors
from spokeworks.operators.staging import stage

SAMPLE = 50_000  # rows that the tree is fitted to, the first by a hash of the id
BRANCHES = 16
PER_LEAF = 8  # sampled rows a leaf has at least
CALIBRATION = 200  # queries whose exact neighbours set the number of visits
RECALL = 0.97  # share of these neighbours that has to be in the visited leaves
BLOCK = 2048  # rows, of queries or vectors, of one leaf that a task row holds


@dataclass
class Tree:
    """Centres of all nodes, the largest distance seen below each, and children; leaves are numbered."""

    centre: np.ndarray
    radius: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray  # number of the leaf, -1 inside
    leaves: int

    def assign(self, vec: np.ndarray) -> np.ndarray:
        """The leaf of each vector: down from the root to the nearest centre each time."""
        out = np.full(len(vec), -1, np.int32)
        stack = [(0, np.arange(len(vec)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            kids = self.children[node]
            near = _nearest(vec[rows], self.centre[kids])
            stack.extend((int(k), rows[near == i]) for i, k in enumerate(kids))
        return out

    def order(self, query: np.ndarray, visits: int) -> list[int]:
        """The first ``visits`` leaves by best bin first.

        A node promises the inner product with its centre, and what a vector as
        far off as any sampled below it could add.
        """
        length = float(np.linalg.norm(query))
        heap, out = [(0.0, 0)], []
        while heap and len(out) < visits:
            _, node = heapq.heappop(heap)
            if self.leaf[node] >= 0:
                out.append(int(self.leaf[node]))
                continue
            kids = self.children[node]
            promise = self.centre[kids] @ query + length * self.radius[kids]
            for p, k in zip(promise.tolist(), kids.tolist(), strict=True):
                heapq.heappush(heap, (-p, k))
        return out


def _nearest(vec: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return (vec @ centre.T * 2 - (centre * centre).sum(axis=1)).argmax(axis=1)


def fit(sample: np.ndarray, leaves: int, rounds: int = 8, seed: int = 7) -> Tree:
    """Split the sample by k-means, the largest part first, until there are enough leaves.

    Parts that can't be split, because all their rows are equal, stay leaves.
    """
    draw = np.random.Generator(np.random.PCG64(seed))
    centre, radius, children, rows = [sample.mean(axis=0)], [0.0], [np.empty(0, int)], [np.arange(len(sample))]
    open_parts = [(-len(sample), 0)]
    count = 1
    while open_parts and count < leaves:
        size, node = heapq.heappop(open_parts)
        own = sample[rows[node]]
        k = min(BRANCHES, leaves - count + 1, max(2, -size // PER_LEAF))
        if -size < 2 * PER_LEAF:
            break
        centres = own[draw.choice(len(own), k, replace=False)]
        for _ in range(rounds):
            near = _nearest(own, centres)
            number = np.bincount(near, minlength=k)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, own)
            centres = np.where(number[:, None] > 0, sums / np.maximum(number, 1)[:, None], centres)
        near = _nearest(own, centres)
        used = np.unique(near)
        if len(used) < 2:
            continue
        kids = []
        for i in used:
            part = rows[node][near == i]
            away = np.linalg.norm(sample[part] - centres[i], axis=1)
            kids.append(len(centre))
            centre.append(centres[i])
            radius.append(float(np.median(away)))
            children.append(np.empty(0, int))
            rows.append(part)
            heapq.heappush(open_parts, (-len(part), kids[-1]))
        children[node] = np.array(kids)
        count += len(kids) - 1
    inner = np.array([len(c) > 0 for c in children])
    leaf = np.where(inner, -1, np.cumsum(~inner) - 1)
    return Tree(np.array(centre), np.array(radius), children, leaf, int((~inner).sum()))


def _blocks(rows: DataFrame, id_: str, name: str, *more: str) -> DataFrame:
    """``leaf, <name>_ids, <name>_vecs`` and more columns: rows of a leaf in blocks of about ``BLOCK``."""
    sizes = rows.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias("_blocks"))
    return (
        rows.join(sizes, "leaf")
        .withColumn("_block", F.pmod(F.xxhash64(id_), F.col("_blocks")))
        .groupBy("leaf", "_block")
        .agg(F.collect_list(F.struct(F.col(id_).alias("id"), "vec", *more)).alias("rows"))
        .select(
            "leaf",
            F.col("rows.id").alias(f"{name}_ids"),
            F.col("rows.vec").alias(f"{name}_vecs"),
            *(F.col(f"rows.{c}").alias(f"{name}_{c}s") for c in more),
        )
    )


def _scored(queries: DataFrame, base: DataFrame, k: int, width: int) -> DataFrame:
    """``query_id, vec_id, score``: the best ``k`` of each pair of blocks that share a leaf.

    Only scores that reach a query's ``bound``, if it has one. Ties go to the
    smaller id; a query isn't its own neighbour.
    """

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.slice(row, 1)
                q_ids, v_ids, least = (
                    part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("q_ids", "v_ids", "q_bounds")
                )
                q, v = (matrix(part.column(c).flatten(), width) for c in ("q_vecs", "v_vecs"))
                out: list[list[np.ndarray]] = [[], [], []]
                for at in range(0, len(q), 256):
                    scores = q[at : at + 256] @ v.T
                    scores[q_ids[at : at + 256, None] == v_ids] = -np.inf
                    bound = least[at : at + 256].copy()
                    if len(v) > k:
                        bound = np.maximum(bound, -np.partition(-scores, k - 1, axis=1)[:, k - 1])
                    i, j = np.nonzero((scores >= bound[:, None]) & (scores > -np.inf))
                    order = np.lexsort((v_ids[j], -scores[i, j], i))
                    i, j = i[order], j[order]
                    begin = np.searchsorted(i, np.arange(len(scores)))
                    keep = np.arange(len(i)) - begin[i] < k
                    i, j = i[keep], j[keep]
                    for column, x in zip(out, (q_ids[at + i], v_ids[j], scores[i, j]), strict=True):
                        column.append(x)
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in out], names=["query_id", "vec_id", "score"])

    bounded = queries if "bound" in queries.columns else queries.withColumn("bound", F.lit(float("-inf")))
    both = _blocks(bounded, "query_id", "q", "bound").join(_blocks(base, "vec_id", "v"), "leaf")
    return both.select("q_ids", "q_vecs", "q_bounds", "v_ids", "v_vecs").mapInArrow(
        task, "query_id bigint, vec_id bigint, score double"
    )


def _best(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return scored.distinct().withColumn("rank", rank).where(F.col("rank") <= k)


def index(base: DataFrame, width: int, rows: int) -> tuple[Tree, DataFrame]:
    """A tree fitted to a sample of ``vec_id, vec``, and all rows with their ``leaf``, written."""
    picked = first_by_hash(base, "vec_id", SAMPLE, rows).select("hash", "vec_id", "vec").toArrow()
    picked = picked.sort_by([("hash", "ascending"), ("vec_id", "ascending")]).slice(0, SAMPLE)
    sample = matrix(picked.column("vec").combine_chunks(), width)
    tree = fit(sample, max(1, min(math.isqrt(rows), len(sample) // PER_LEAF)))
    shared = base.sparkSession.sparkContext.broadcast(tree)  # bounded by the sample

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.assign(matrix(batch.column("vec"), width))
            yield pa.record_batch([batch.column("vec_id"), batch.column("vec"), pa.array(leaf, pa.int32())], names=["vec_id", "vec", "leaf"])

    return tree, stage(base.mapInArrow(task, "vec_id bigint, vec array<double>, leaf int"), "tree-leaves")


def _visiting(queries: DataFrame, tree: Tree, visits: int, width: int) -> DataFrame:
    """``query_id, vec, leaf, place``: the leaves each query visits, in order."""
    shared = queries.sparkSession.sparkContext.broadcast(tree)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = matrix(batch.column("vec"), width)
            for at in range(0, len(vec), 256):
                part = batch.slice(at, 256)
                leaves = [shared.value.order(q, visits) for q in vec[at : at + 256]]
                row = np.repeat(np.arange(len(leaves)), [len(x) for x in leaves])
                own = part.take(pa.array(row))
                yield pa.record_batch(
                    [
                        own.column("query_id"),
                        own.column("vec"),
                        pa.array(np.concatenate([np.array(x, np.int32) for x in leaves])),
                        pa.array(np.concatenate([np.arange(len(x), dtype=np.int32) for x in leaves])),
                    ],
                    names=["query_id", "vec", "leaf", "place"],
                )

    return queries.mapInArrow(task, "query_id bigint, vec array<double>, leaf int, place int")


def visits_needed(queries: DataFrame, base: DataFrame, tree: Tree, k: int, width: int, recall: float = RECALL) -> int:
    """Leaves to visit so that the exact neighbours of some queries are reached.

    About ``CALIBRATION`` queries, the first by a hash of the id, are compared with
    all rows in blocks; the place of a neighbour's leaf in its query's order is
    the number of visits that finds it.
    """
    some = stage(first_by_hash(queries, "query_id", CALIBRATION, queries.count()).drop("hash"), "tree-calibration")
    every = stage(_visiting(some, tree, tree.leaves, width), "tree-order")
    exact = _best(_scored(every.select("query_id", "vec", "leaf"), base, k, width), k)
    placed = every.select("query_id", "leaf", "place")
    places = (
        exact.select("query_id", "vec_id")
        .join(base.select("vec_id", "leaf"), "vec_id")
        .join(placed, ["query_id", "leaf"])
        .groupBy("place")
        .count()
        .orderBy("place")
        .collect()
    )
    total = sum(r["count"] for r in places)
    found = 0
    for r in places:
        found += r["count"]
        if found >= recall * total:
            return r["place"] + 1
    return tree.leaves


def search(df: DataFrame, is_query, k: int = 20, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for each query, nearest first.

    Nearness is the largest inner product, in double precision; ties go to the
    smaller id. Queries are the rows of ``vec_id, embedding`` that ``is_query``,
    a condition on ``vec_id``, selects; candidates are all rows but those with
    the query's own id. With fewer candidates all are returned. Rows without an
    id, and vectors that are null, empty, zero or hold null or non-finite
    components, take no part, nor do those of another length than most rows
    have. Repeated rows are one candidate. Other columns are ignored; an empty
    table, or one without queries, gives no rows.

    A leaf's queries and vectors are dealt into blocks that meet pair by pair,
    so a leaf with a large share of the rows is spread over many tasks. Of the
    visits, the square root of their number comes first; the worst of the best
    ``k`` found there is what a score in the other leaves has to reach.
    """
    spark = df.sparkSession
    valid = stage(vectors(df).where(F.col("vec_id").isNotNull() & usable(F.col("vec"))).distinct(), "tree-vectors")
    widths = valid.groupBy(F.size("vec").alias("w")).count().orderBy(F.col("count").desc(), F.col("w").desc()).first()
    if widths is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    width = widths["w"]
    valid = valid.where(F.size("vec") == width)
    tree, base = index(valid, width, widths["count"])
    queries = valid.where(is_query).withColumnRenamed("vec_id", "query_id")
    visits = visits_needed(queries, base, tree, k, width, recall)
    places = stage(_visiting(queries, tree, visits, width).select("query_id", "leaf", "place"), "tree-visits")
    early = math.isqrt(visits - 1) + 1
    asked = places.join(queries, "query_id")
    found = stage(_best(_scored(asked.where(F.col("place") < early), base, k, width), k), "tree-early")
    bounds = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    late = asked.where(F.col("place") >= early).join(bounds, "query_id", "left")
    late = late.withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    both = found.drop("rank").unionByName(_scored(late, base, k, width))
    return _best(both, k).select("query_id", "rank", "vec_id", "score")
