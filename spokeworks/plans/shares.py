"""Daily shares: of all trips in the period, and of trips against fleet."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spokeworks.functions.classify import CLASSIC, PLUS
from spokeworks.operators.reshape import stack_rows
from spokeworks.plans.fleet import calendar_use, daily_use, with_fleet
from spokeworks.plans.history import History
from spokeworks.plans.selections import within


def daily_share_of_total(trips: DataFrame, first: dt.date) -> DataFrame:
    """Each day's trips, their period totals, and the day's share of them, by type.

    The totals are added up from the daily rows, one per calendar day, in a
    window without a key.
    """
    period = Window.partitionBy()
    return (
        daily_use(within(trips, first))
        .select("date", "classic_trips", "plus_trips", "plus_used")
        .withColumns(
            {
                "total_classic_trips": F.sum("classic_trips").over(period),
                "total_plus_trips": F.sum("plus_trips").over(period),
            }
        )
        .withColumns(
            {
                "classic_share": F.try_divide("classic_trips", "total_classic_trips"),
                "plus_share": F.try_divide("plus_trips", "total_plus_trips"),
            }
        )
        .orderBy("date")
    )


def daily_share_long(shares: DataFrame) -> DataFrame:
    """``date, plus_used, bike_type, share`` from ``daily_share_of_total``."""
    return stack_rows(
        shares,
        ["date", "plus_used"],
        [
            {"bike_type": F.lit(CLASSIC), "share": F.col("classic_share")},
            {"bike_type": F.lit(PLUS), "share": F.col("plus_share")},
        ],
    )


def fleet_vs_trip_share(
    trips: DataFrame,
    first: dt.date,
    last: dt.date,
    from_day: dt.date | None = None,
    kept: History | None = None,
) -> DataFrame:
    """Each calendar day: trips by type, and the plus share of trips and of fleet."""
    use = calendar_use(trips, first, last, from_day or first, kept).select(
        "date",
        "plus_trips",
        "classic_trips",
        F.col("all_trips").alias("total_trips"),
        F.try_divide("plus_trips", "all_trips").alias("plus_trip_share"),
    )
    fleet = F.col("classic_fleet") + F.col("plus_fleet")
    return (
        with_fleet(use, trips, kept)
        .withColumn("total_fleet", fleet)
        .withColumn("plus_fleet_share", F.try_divide("plus_fleet", "total_fleet"))
        .drop("classic_fleet")
    )


def fleet_vs_trip_share_long(daily: DataFrame) -> DataFrame:
    """Two rows per day of ``fleet_vs_trip_share``: a share beside a trip count."""
    return stack_rows(
        daily,
        ["date"],
        [
            {
                "stat_type": F.lit("% of Trips"),
                "plus_stat": F.col("plus_trip_share"),
                "trip_type": F.lit(f"{PLUS} Trips"),
                "daily_trips": F.col("plus_trips"),
            },
            {
                "stat_type": F.lit("% of Fleet"),
                "plus_stat": F.col("plus_fleet_share"),
                "trip_type": F.lit(f"{CLASSIC} Trips"),
                "daily_trips": F.col("classic_trips"),
            },
        ],
    )
