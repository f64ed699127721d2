"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spokeworks.operators.staging import stage

#: Links that are few enough for one task, some 50 MB while it works; more are joined in rounds.
FEW = 500_000


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links, sorted, and the smallest node of each one's component.

    The larger of two roots is hung on the smaller one for all links at once, and
    paths are halved, until every link lies below one root.
    """
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while len(a):
        x, y = parent[a], parent[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
    return nodes, nodes[parent]


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of the links ``a, b``; a component is its smallest node.

    Up to ``FEW`` links, which are counted first, are one task's work. More are joined in rounds:

    Large-star and small-star steps in turn: the first hangs a node's larger
    neighbours on its smallest one, the second its smaller ones. Links are never
    more than at the start. Each step groups by node with a minimum, which
    combines in the tasks, and its result is written, so lineage stays short and
    a lost executor costs one step at most. Links of a node with itself or with
    null are left out.
    """
    links = stage(links.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).where("a <> b"), "links")
    if links.count() <= FEW:  # repeated ones are as good, and no shuffle is needed
        return _at_once(links)
    now = stage(_downward(links, "a", "b"), "distinct-links")
    state = _state(now)
    if state["n"] <= FEW:
        return _at_once(now)
    while state["n"]:
        both = now.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(
            now.select(F.col("b").alias("node"), F.col("a").alias("near"))
        )
        least = both.groupBy("node").agg(F.min("near").alias("least")).select("node", F.least("node", "least").alias("least"))
        large = both.where("near > node").join(least, "node").select(F.col("near").alias("a"), F.col("least").alias("b"))
        large = stage(_downward(large, "a", "b"), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        hung = large.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        small = _downward(hung.unionByName(least.select("a", F.col("least").alias("b"))), "a", "b")
        now = stage(small, "small-star")
        before, state = state, _state(now)
        if before == state:
            break
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _at_once(links: DataFrame) -> DataFrame:
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [[batch.column(c).to_numpy() for c in ("a", "b")] for batch in batches]
        if read:
            nodes, found = joined(*(np.concatenate(x) for x in zip(*read, strict=True)))
            yield pa.record_batch([pa.array(nodes), pa.array(found)], names=["node", "component"])

    return links.coalesce(1).mapInArrow(task, "node bigint, component bigint")


def _downward(links: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct links from the larger to the smaller node."""
    return (
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    )


def _state(links: DataFrame):
    """Equal only while the links stay the same."""
    spread = F.xxhash64("a", "b").cast("decimal(20,0)")
    return links.agg(F.count("*").alias("n"), F.sum(spread).alias("h")).first().asDict()
