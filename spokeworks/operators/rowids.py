"""Consecutive ids for the rows of a directory of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spokeworks.operators.lookup import attach, fits_broadcast
from spokeworks.operators.staging import stage

FILE, BLOCK, SEQUENCE = "_file", "_block", "_sequence"

# Splits whose list is broadcast: enough for some 250 TB in splits of 128 MB.
SPLITS = 2_000_000
SPLIT_BYTES = 64


def with_file_position(scan: DataFrame) -> DataFrame:
    """Add where each row stands: file, start of its split, and a number that
    grows along the split. To be called on the scan itself, before any
    filter, so that the rows of a split are numbered without gaps.
    """
    return scan.select(
        "*",
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias(SEQUENCE),
    )


def number_rows(positioned: DataFrame, last_id: int, name: str) -> DataFrame:
    """Replace the position by ``name``: ``last_id + 1, last_id + 2, ...`` in the
    order of files, then of rows within the file.

    ``positioned`` must come from a written copy (``stage``), which holds the
    positions fixed. No row is sorted or moved: a split's rows are already
    numbered, so a row's id is its distance from the start of its split plus
    the size of all splits before it. Only the list of splits is ordered, and
    broadcast if it is short enough. A row finds its split by the task
    that read it, which the upper bits of its number tell, and by its number.
    """
    splits = positioned.groupBy(FILE, BLOCK).agg(
        F.min(SEQUENCE).alias("_from"), F.max(SEQUENCE).alias("_to"), F.count("*").alias("_rows")
    )
    # The path is percent-encoded, which would sort some names in another order.
    plain = F.url_decode(F.replace(FILE, F.lit("+"), F.lit("%2B")))
    files = (
        splits.groupBy(FILE)
        .agg(F.sum("_rows").alias("_file_rows"))
        .withColumn("_plain", plain)
    )
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(
        F.col(FILE).alias("_in_file"),
        F.coalesce(F.sum("_file_rows").over(earlier.orderBy("_plain", FILE)), F.lit(0)).alias("_above"),
    )
    within = F.sum("_rows").over(earlier.partitionBy(FILE).orderBy(BLOCK))
    offsets = stage(
        splits.withColumn("_before", F.coalesce(within, F.lit(0)))
        .join(files, F.col(FILE) == F.col("_in_file"))
        .select(
            _task("_from").alias("_in_task"),
            "_from",
            "_to",
            (F.col("_above") + F.col("_before") - F.col("_from")).alias("_offset"),
        ),
        "splits",
    )
    return (
        attach(
            positioned.withColumn("_task", _task(SEQUENCE)),
            offsets,
            {"_task": "_in_task"},
            F.col(SEQUENCE).between(F.col("_from"), F.col("_to")),
            small=fits_broadcast(offsets, SPLITS, SPLITS * SPLIT_BYTES),
        )
        .withColumn(name, F.col(SEQUENCE) + F.col("_offset") + F.lit(last_id + 1))
        .drop(FILE, BLOCK, SEQUENCE, "_task", *offsets.columns)
    )


def _task(number: str) -> Column:
    """The task that gave a row its ``monotonically_increasing_id``."""
    return F.shiftright(number, 33)
