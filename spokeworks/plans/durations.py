"""Trip durations: means by date, weekday and month, and same-station trips."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spokeworks.functions.classify import bike_type
from spokeworks.functions.durations import (
    US_PER_HOUR,
    US_PER_SECOND,
    day_of_week,
    elapsed_us,
    mean_seconds,
    minutes,
)
from spokeworks.operators.ranking import running_share
from spokeworks.plans.selections import by_member_type, forward, same_station, within


def _mean_duration(trips: DataFrame, key: Column, name: str) -> DataFrame:
    return trips.groupBy(key.alias(name), bike_type("bike_number").alias("bike_type")).agg(
        mean_seconds(elapsed_us()).alias("avg_seconds")
    )


def avg_duration_by_date(
    trips: DataFrame, first: dt.date, member_type: str | None = None
) -> DataFrame:
    """``date, bike_type, avg_seconds``, of one member type if given."""
    chosen = within(trips, first).where(forward())
    if member_type is not None:
        chosen = chosen.where(by_member_type(member_type))
    return _mean_duration(chosen, F.to_date("start_date"), "date")


def avg_duration_by_dow(trips: DataFrame, first: dt.date) -> DataFrame:
    """``dow, bike_type, avg_seconds``; 0 is Sunday."""
    return _mean_duration(within(trips, first).where(forward()), day_of_week(), "dow")


def monthly_basic_stats(trips: DataFrame, first: dt.date, by_year: bool = False) -> DataFrame:
    """Trips, bikes, mean duration and member split by month and bike type.

    Equal months of different years fall together unless ``by_year``. Also
    counts trips that end before they start.
    """
    keys = {"month": F.month("start_date"), "bike_type": bike_type("bike_number")}
    if by_year:
        keys = {"year": F.year("start_date"), **keys}
    member = F.count_if(by_member_type("Member"))
    return (
        within(trips, first)
        .groupBy(*[c.alias(n) for n, c in keys.items()])
        .agg(
            F.count("*").alias("trips"),
            F.countDistinct("bike_number").alias("bikes"),
            mean_seconds(elapsed_us()).alias("avg_seconds"),
            (member / F.count("*")).alias("member_share"),
            F.count_if(by_member_type("Casual")).alias("casual_trips"),
            member.alias("member_trips"),
        )
        .orderBy("bike_type", *[k for k in keys if k != "bike_type"])
    )


def same_station_share(
    trips: DataFrame, first: dt.date, member_type: str = "Member"
) -> DataFrame:
    """``bike_type, same_station_share`` of trips that end where they began."""
    return (
        within(trips, first)
        .where(forward() & by_member_type(member_type))
        .groupBy(bike_type("bike_number").alias("bike_type"))
        .agg((F.count_if(same_station()) / F.count("*")).alias("same_station_share"))
    )


def _short_same_station(
    trips: DataFrame, first: dt.date, member_type: str, below_us: int
) -> DataFrame:
    return (
        within(trips, first)
        .where(forward() & by_member_type(member_type) & same_station())
        .select(
            bike_type("bike_number").alias("bike_type"), elapsed_us().alias("duration_us")
        )
        .where(F.col("duration_us") < below_us)
    )


def same_station_duration_stats(
    trips: DataFrame,
    first: dt.date,
    member_type: str = "Member",
    below_us: int = US_PER_HOUR,
) -> DataFrame:
    """Shortest, mean and longest of the same-station trips below a limit."""
    us = F.col("duration_us")
    return (
        _short_same_station(trips, first, member_type, below_us)
        .groupBy("bike_type")
        .agg(
            (F.min(us) / US_PER_SECOND).alias("min_seconds"),
            mean_seconds(us).alias("avg_seconds"),
            (F.max(us) / US_PER_SECOND).alias("max_seconds"),
        )
    )


def same_station_duration_hist(
    trips: DataFrame,
    first: dt.date,
    member_type: str = "Member",
    below_us: int = US_PER_HOUR,
) -> DataFrame:
    """``bike_type, duration_us, trips``, in order."""
    return _same_station_counts(trips, first, member_type, below_us).orderBy(
        "bike_type", "duration_us"
    )


def _same_station_counts(
    trips: DataFrame, first: dt.date, member_type: str, below_us: int
) -> DataFrame:
    return (
        _short_same_station(trips, first, member_type, below_us)
        .groupBy("bike_type", "duration_us")
        .agg(F.count("*").alias("trips"))
    )


def same_station_duration_cdf(
    trips: DataFrame,
    first: dt.date,
    member_type: str = "Member",
    below_us: int = US_PER_HOUR,
) -> DataFrame:
    """``bike_type, minutes, trips, running_share``: the share of trips up to a duration.

    Accumulated second by second, so a slice holds at most a million durations.
    """
    second = F.floor(F.col("duration_us") / US_PER_SECOND)
    counts = _same_station_counts(trips, first, member_type, below_us)
    shared = running_share(counts, "bike_type", "duration_us", "trips", second, "running_share")
    return shared.select(
        "bike_type", minutes(F.col("duration_us")).alias("minutes"), "trips", "running_share"
    )


def first_trip_per_bike(trips: DataFrame) -> DataFrame:
    """``bike_number, first_start``; trips without a bike number have no row."""
    return (
        trips.where(F.col("bike_number").isNotNull())
        .groupBy("bike_number")
        .agg(F.min("start_date").alias("first_start"))
    )
