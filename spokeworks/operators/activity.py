"""Calendars, active intervals, and how many intervals are open on each day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spokeworks.functions.durations import first_of_next_month


def calendar(spark: SparkSession, first: dt.date, last: dt.date) -> DataFrame:
    """One row ``date`` per day; both ends belong to it."""
    days = F.sequence(F.lit(first), F.lit(last), F.expr("interval 1 day"))
    return spark.range(1).select(F.explode(days).alias("date"))


def active_intervals(trips: DataFrame, key: str = "bike_number") -> DataFrame:
    """``key, first_day, last_day``: from its first trip to the first day of the
    month after its last trip, both included. Rows without a key have none.

    ``min`` and ``max`` are combined before the shuffle, so a busy bike
    sends one row per task.
    """
    lives = (
        trips.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min("start_date").alias("first_start"), F.max("start_date").alias("last_start"))
    )
    return intervals_of_lives(lives, key)


def intervals_of_lives(lives: DataFrame, key: str = "bike_number") -> DataFrame:
    """``active_intervals`` of keys whose first and last trip are known."""
    return lives.select(
        key,
        F.to_date("first_start").alias("first_day"),
        first_of_next_month(F.col("last_start")).alias("last_day"),
    )


def with_active_counts(
    days: DataFrame, intervals: DataFrame, counts: dict[str, Column]
) -> DataFrame:
    """Add to each row of ``days`` how many intervals contain its ``date``.

    ``counts`` maps an output column to the condition on ``intervals`` that it
    counts. In place of a day-by-interval range join, each interval becomes +1
    on its first day and -1 on the day after its last; these are summed by day
    and then accumulated. All that is left for the one ordered window
    is a row per calendar day, whatever the number of intervals.
    """
    edges = F.array(
        F.struct(F.col("first_day").alias("date"), F.lit(1).alias("step")),
        F.struct(F.date_add("last_day", 1).alias("date"), F.lit(-1).alias("step")),
    )
    steps = (
        intervals.select(
            F.explode(edges).alias("edge"),
            *[F.when(cond, 1).otherwise(0).alias(name) for name, cond in counts.items()],
        )
        .groupBy(F.col("edge.date").alias("date"))
        .agg(*[F.sum(F.col(name) * F.col("edge.step")).alias(name) for name in counts])
        .withColumn("_day", F.lit(False))
    )
    marked = days.withColumn("_day", F.lit(True))
    up_to_date = Window.orderBy("date").rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    line = marked.unionByName(steps, allowMissingColumns=True)
    totals = {name: F.coalesce(F.sum(name).over(up_to_date), F.lit(0)) for name in counts}
    return line.withColumns(totals).where("_day").drop("_day")
