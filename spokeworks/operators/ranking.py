"""Top rows per group and running shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group in a total ``order``.

    Spark limits each group inside every task before the shuffle, so a group
    of any size sends at most ``n`` rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def running_share(
    df: DataFrame, group: str, order: str, value: str, bucket: Column, share: str
) -> DataFrame:
    """Add ``share``: the part of the group's total ``value`` reached at this row.

    Rows are ordered by ``order`` (unique in a group). ``bucket`` must not
    decrease as ``order`` grows. Buckets are totalled and accumulated first;
    then each bucket is accumulated on its own and lifted by the total of the
    buckets before it. A group is thus spread over its buckets and
    never sorted as a whole.
    """
    rows = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    whole = Window.partitionBy(group)
    buckets = (
        rows.groupBy(group, "_bucket")
        .agg(F.sum(value).alias("_sum"))
        .select(
            F.col(group).alias("_group"),
            F.col("_bucket").alias("_in"),
            F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"),
            F.sum("_sum").over(whole).alias("_total"),
        )
    )
    inside = Window.partitionBy(group, "_bucket").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # Null-safe on both keys: no "is not null" is then pushed into one side only, and
    # Spark sees that both sides can share one scan and shuffle of ``df``.
    same = F.col(group).eqNullSafe(F.col("_group")) & F.col("_bucket").eqNullSafe(F.col("_in"))
    return (
        rows.withColumn("_run", F.sum(value).over(inside))
        .join(buckets, same)
        .withColumn(share, F.try_divide(F.col("_before") + F.col("_run"), F.col("_total")))
        .drop("_bucket", "_run", "_group", "_in", "_before", "_total")
    )
