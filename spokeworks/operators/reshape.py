"""Wide to long with several columns at a time, and written-out rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stack_rows(df: DataFrame, ids: Sequence[str], rows: Sequence[dict[str, Column]]) -> DataFrame:
    """For each row of ``df``, one row per entry of ``rows`` beside ``ids``."""
    entries = [F.struct(*[c.alias(name) for name, c in row.items()]) for row in rows]
    return df.select(*ids, F.inline(F.array(*entries)))


def literal_rows(
    spark: SparkSession, columns: Sequence[str], rows: Sequence[Sequence[object]]
) -> DataFrame:
    """A frame of the written-out ``rows``, at least one of them."""
    entries = [
        F.struct(*[F.lit(v).alias(name) for name, v in zip(columns, row, strict=True)])
        for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*entries)))
