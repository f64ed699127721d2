"""Daily trips, bikes used and fleet size."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spokeworks.functions.classify import is_classic
from spokeworks.operators.activity import (
    active_intervals,
    calendar,
    intervals_of_lives,
    with_active_counts,
)
from spokeworks.plans import history
from spokeworks.plans.history import History
from spokeworks.plans.selections import within


def daily_use(trips: DataFrame) -> DataFrame:
    """``date, classic_trips, plus_trips, all_trips, classic_used, plus_used``.

    Trips are first counted per day and bike, which spreads a busy day over
    its bikes and leaves each bike once, so that distinct bikes are plain sums.
    Trips without a bike number count in ``all_trips`` only.
    """
    classic = is_classic("bike_number")
    return (
        trips.groupBy(F.to_date("start_date").alias("date"), "bike_number")
        .agg(F.count("*").alias("n"))
        .groupBy("date")
        .agg(
            F.sum(F.when(classic, F.col("n")).otherwise(0)).alias("classic_trips"),
            F.sum(F.when(~classic, F.col("n")).otherwise(0)).alias("plus_trips"),
            F.sum("n").alias("all_trips"),
            F.count_if(classic).alias("classic_used"),
            F.count_if(~classic).alias("plus_used"),
        )
    )


def with_fleet(days: DataFrame, trips: DataFrame, kept: History | None = None) -> DataFrame:
    """Add ``classic_fleet, plus_fleet``: bikes active on each day, by the whole
    trip history, or by the ``kept`` first and last trips of all bikes."""
    classic = is_classic("bike_number")
    intervals = active_intervals(trips) if kept is None else intervals_of_lives(kept.lives)
    return with_active_counts(days, intervals, {"classic_fleet": classic, "plus_fleet": ~classic})


def calendar_use(
    trips: DataFrame, first: dt.date, last: dt.date, from_day: dt.date, kept: History | None = None
) -> DataFrame:
    """``daily_use`` of trips since ``from_day`` on every day ``first..last``; days
    without trips have NULLs.

    The daily side has at most one row per calendar day, which is why it may
    be broadcast.
    """
    use = _daily_use(trips, max(first, from_day), last, kept)
    return calendar(trips.sparkSession, first, last).join(F.broadcast(use), "date", "left")


def _daily_use(
    trips: DataFrame, first: dt.date, last: dt.date | None, kept: History | None
) -> DataFrame:
    return daily_use(within(trips, first, last)) if kept is None else history.daily_use(kept, first, last)


def daily_fleet_calendar(
    trips: DataFrame,
    first: dt.date,
    last: dt.date,
    from_day: dt.date | None = None,
    kept: History | None = None,
) -> DataFrame:
    """Each calendar day with trips and fleet by bike type."""
    return with_fleet(
        calendar_use(trips, first, last, from_day or first, kept).select(
            "date", "classic_trips", "plus_trips"
        ),
        trips,
        kept,
    )


def daily_fleet_trip_days(
    trips: DataFrame, first: dt.date, kept: History | None = None
) -> DataFrame:
    """Each day with trips: trips, bikes used and fleet by bike type."""
    use = _daily_use(trips, first, None, kept).drop("all_trips")
    return with_fleet(use, trips, kept).orderBy("date")


def first_seen_in_window(
    trips: DataFrame, first: dt.date, last: dt.date, lives: DataFrame | None = None
) -> DataFrame:
    """``bike_number`` of bikes whose first trip lies in ``first..last``, by the trips or by kept ``lives``."""
    if lives is None:
        lives = trips.groupBy("bike_number").agg(F.min("start_date").alias("first_start"))
    first_day = F.to_date("first_start")
    return lives.where(first_day.between(F.lit(first), F.lit(last))).select("bike_number")


def ebike_fleet_calendar(
    trips: DataFrame,
    ebikes: DataFrame,
    first: dt.date,
    last: dt.date,
    from_day: dt.date | None = None,
    lives: DataFrame | None = None,
) -> DataFrame:
    """Each calendar day with trips and fleet, split by membership in ``ebikes``.

    The fleet is that of the whole trip history, or of the kept ``lives`` of all bikes.
    The list of e-bikes grows with the fleet, so it is not broadcast by
    force; it meets one row per bike, or per bike and day, never the
    trips themselves.
    """
    electric = ebikes.select("bike_number").distinct().withColumn("electric", F.lit(True))

    def flagged(bikes: DataFrame) -> DataFrame:
        return bikes.join(electric, "bike_number", "left").withColumn(
            "electric", F.coalesce("electric", F.lit(False))
        )

    per_bike = (
        within(trips, max(first, from_day or first), last)
        .groupBy(F.to_date("start_date").alias("date"), "bike_number")
        .agg(F.count("*").alias("n"))
    )
    counted = F.when(F.col("bike_number").isNotNull(), F.col("n")).otherwise(0)
    use = (
        flagged(per_bike)
        .groupBy("date")
        .agg(
            F.sum(F.when(~F.col("electric"), counted).otherwise(0)).alias("trips"),
            F.sum(F.when(F.col("electric"), counted).otherwise(0)).alias("ebike_trips"),
        )
    )
    days = calendar(trips.sparkSession, first, last).join(F.broadcast(use), "date", "left")
    return with_active_counts(
        days,
        flagged(
            active_intervals(trips)
            if lives is None
            else intervals_of_lives(lives.where("bike_number IS NOT NULL"))
        ),
        {"bikes": ~F.col("electric"), "ebikes": F.col("electric")},
    )
