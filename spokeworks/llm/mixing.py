"""Mixing sources to target weights by weighted fair queueing.

Each source queues its documents in a shuffled order, and then once more. A
document's virtual finish time is what its source has queued up to its end,
over the source's target. All queues together, sorted by that time, keep every
source near its share at any point; the mix is what comes before the total
budget is used up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spokeworks.llm.batches import columns, unused
from spokeworks.operators.staging import stage

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)  # the budget over all sizes, as a fraction
_ROWS_PER_BUCKET = 2_000
SEED = "mix"
KNOWN_IDS = 1_000_000  # ids that are broadcast, 16 MB; more are joined by a shuffle


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, key``: words of each text (null: 0), and a key to shuffle by."""
    return columns(docs, doc_id="bigint", source="string", text="string").select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint").alias("size"),
        F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key"),
    )


def targets(sized: DataFrame) -> DataFrame:
    """``source, rank, source_size, target``, one row per source.

    Sources in order of code points, null last, weigh ``WEIGHTS`` in turn. A
    target stops at twice its source's size, and what is above is shared again
    by weight: with sources sorted by size over weight, the first that stays
    below its bound sets the level of all that follow.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    ranked = per.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ).withColumn("weight", weight.cast("bigint"))
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    all_rows = Window.partitionBy()
    up, down = SHARE
    # what is left for a source and those after it, times twice the fraction's lower part
    left = F.sum("source_size").over(all_rows) * up - 2 * down * F.coalesce(
        F.sum("source_size").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    levels = ranked.select(
        "*",
        left.alias("left"),
        F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("weights"),
        F.row_number().over(by_level).alias("place"),
    ).withColumn("full", F.col("weight") * F.col("left") > 2 * down * F.col("source_size") * F.col("weights"))
    level = F.min(F.when(~F.col("full"), F.struct("place", "left", "weights"))).over(all_rows)
    return levels.withColumn("level", level).select(
        "source",
        "rank",
        "source_size",
        F.when(F.col("level").isNull() | (F.col("place") < F.col("level.place")), 2.0 * F.col("source_size"))
        .otherwise((F.col("weight") * F.col("level.left")).cast("double") / (down * F.col("level.weights")).cast("double"))
        .alias("target"),
    )


def mix(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` of each row of ``doc_id, text, source``.

    ``taken`` is ``copies`` (0 to 2) times the size. Whole documents are taken,
    in order of virtual finish time, source, round, key, id and size, up to the
    first that would exceed the budget. Rows that are equal in all of these are
    taken alike. A null source is a source of its own, the last; null or empty
    text has no words and takes none; a source without words has target 0. An
    empty table stays empty. Other columns are ignored.

    Sums run over two levels, buckets and rows of a bucket, so that no task
    sorts a whole source or the whole queue; the number of buckets grows with
    the rows. The windows without a key see a row per source or per bucket.
    """
    sized = stage(sizes(docs), "mix-sizes")
    total = sized.agg(F.count("*").alias("rows"), F.sum("size").alias("words")).first()
    digits = max(1, math.ceil(math.log(max(total["rows"], 1) / _ROWS_PER_BUCKET + 1, 16)))
    budget = (total["words"] or 0) * SHARE[0] // SHARE[1]

    per_source = stage(targets(sized), "mix-targets")
    with_target = sized.alias("d").join(per_source.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select(
        "doc_id", "size", "key", "rank", "source_size", "target", F.substring("key", 1, digits).alias("bucket")
    )
    before = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bucket_start = (
        with_target.groupBy("rank", "bucket")
        .agg(F.sum("size").alias("words"))
        .select("rank", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    )
    within = Window.partitionBy("rank", "bucket").orderBy("key", "doc_id", "size")
    queued = stage(
        with_target.join(bucket_start, ["rank", "bucket"]).select(
            "doc_id", "size", "source_size", "target", "rank", "key",
            (F.col("start") + F.sum("size").over(within)).alias("queued"),
        ),
        "mix-queue",
    )

    buckets = 16**digits
    entries = queued.select(
        F.explode(F.array(*(F.struct(*_entry(k)) for k in (0, 1)))).alias("entry"), F.col("size").alias("words")
    ).withColumn("bucket", F.floor((1 - 1 / (1 + F.col("entry.finish"))) * buckets))
    bucket_sums = entries.groupBy("bucket").agg(F.sum("words").alias("in_bucket"))
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the bucket in which the budget ends is the only one whose rows need an order
    last = (
        bucket_sums.select(
            "bucket", "in_bucket", F.sum("in_bucket").over(upto).alias("end")
        )
        .where(F.col("end") > budget)
        .orderBy("bucket")
        .first()
    )
    copies = F.lit(2)
    if last is not None:
        in_order = Window.orderBy("entry")
        cut = (
            entries.where(F.col("bucket") == last["bucket"])
            .select("entry", F.sum("words").over(in_order).alias("upto"))
            .where(F.col("upto") > budget - (last["end"] - last["in_bucket"]))
            .orderBy("entry")
            .first()["entry"]
        )
        bound = F.struct(*(F.lit(v).cast(t.dataType).alias(t.name) for v, t in zip(cut, entries.schema["entry"].dataType, strict=True)))
        copies = sum((F.struct(*_entry(k)) < bound).cast("int") for k in (0, 1))
    return queued.withColumn("copies", copies).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def _entry(round_: int) -> list[Column]:
    """A document's place in the queue in the given round, the virtual finish time first."""
    words = F.col("queued") + round_ * F.col("source_size")
    finish = F.when(F.col("target") > 0, words.cast("double") / F.col("target")).otherwise(F.lit(0.0))
    return [
        finish.alias("finish"),
        F.col("rank"),
        F.lit(round_).alias("round"),
        F.col("key"),
        F.coalesce("doc_id", F.lit(-(2**63))).alias("id"),
        F.col("size"),
    ]


def mixed(docs: DataFrame) -> DataFrame:
    """The documents the mix takes, each as often as it is taken, with all their columns.

    Rows that share an id, the null id too, are taken alike, as often as the one taken
    most. Null and empty texts have no words and count nothing. An empty table stays
    empty. Columns may have any names.
    """
    id_, copies, copy = unused(docs, "_id", "_copies", "_copy")
    own = mix(docs).where("copies > 0").groupBy(F.col("doc_id").alias(id_)).agg(F.max("copies").alias(copies))
    own = stage(own, "mix-taken")
    if own.count() <= KNOWN_IDS:
        own = F.broadcast(own)
    return (
        docs.join(own, F.col("doc_id").cast("bigint").eqNullSafe(F.col(id_)))
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
        .select(*(F.col(f"`{c}`") for c in docs.columns))
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents
), s AS (
  SELECT source, source_size, rank, CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
               row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
        FROM d GROUP BY source)
), l AS (
  SELECT *, row_number() OVER o AS place,
         3 * sum(source_size) OVER () - 4 * (sum(source_size) OVER o - source_size) AS left_,
         sum(weight) OVER () - (sum(weight) OVER o - weight) AS weights
  FROM s WINDOW o AS (ORDER BY source_size / weight, rank ROWS UNBOUNDED PRECEDING)
), f AS (
  SELECT min(place) AS place FROM l WHERE NOT weight * left_ > 4 * source_size * weights
), t AS (
  SELECT l.source, l.rank, l.source_size,
         CASE WHEN v.place IS NULL OR l.place < v.place THEN 2.0::DOUBLE * l.source_size
              ELSE CAST(l.weight * v.left_ AS DOUBLE) / CAST(2 * v.weights AS DOUBLE) END AS target
  FROM l LEFT JOIN (SELECT l.* FROM l JOIN f USING (place)) v ON true
), q AS (
  SELECT doc_id, size, key, rank, source_size, target,
         sum(size) OVER (PARTITION BY rank ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS queued
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT doc_id, size, key, rank, round,
         CASE WHEN target > 0 THEN CAST(queued + round * source_size AS DOUBLE) / target ELSE 0 END AS finish
  FROM q, (VALUES (0), (1)) r(round)
), c AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, round, key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM e
), k AS (
  SELECT doc_id, key, size, count(*) FILTER (WHERE upto <= (SELECT 3 * sum(size) // 2 FROM d)) AS copies
  FROM c GROUP BY doc_id, key, size
)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * k.copies AS BIGINT) AS taken, CAST(k.copies AS INTEGER) AS copies
FROM q JOIN k ON q.doc_id IS NOT DISTINCT FROM k.doc_id AND q.size = k.size
"""
