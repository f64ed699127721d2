"""Trip distance and speed, their means, and their density curves."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spokeworks.functions.classify import bike_type
from spokeworks.functions.durations import elapsed_us, hours, minutes
from spokeworks.operators.density import counted_density_curves
from spokeworks.operators.density import density_curves as curves
from spokeworks.operators.reshape import stack_rows
from spokeworks.plans.selections import by_member_type, forward, within
from spokeworks.plans.stations import miles_between_ends, with_end_points
from spokeworks.schemas import DENSITY_MAX_MILES, DENSITY_MAX_MINUTES, DENSITY_MAX_MPH


def trip_distance_speed(
    trips: DataFrame,
    stations: DataFrame,
    first: dt.date,
    member_type: str = "Member",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per trip: coordinates of both ends, hours, minutes, miles and mph.

    Trips from or to an unknown station stay, with NULL distance and
    speed. ``keep`` names further trip columns to carry along.
    """
    forwards = within(trips, first).where(forward() & by_member_type(member_type))
    chosen = forwards.select(
        *keep,
        F.to_date("start_date").alias("date"),
        bike_type("bike_number").alias("bike_type"),
        "start_station",
        "end_station",
        elapsed_us().alias("duration_us"),
    )
    us = F.col("duration_us")
    return (
        with_end_points(chosen, stations, "lat", "lon")
        .withColumns(
            {"hours": hours(us), "minutes": minutes(us), "miles": miles_between_ends()}
        )
        .withColumn("mph", F.try_divide("miles", "hours"))
    )


def avg_distance_speed_by_type(measured: DataFrame) -> DataFrame:
    """``bike_type, avg_miles, avg_mph, avg_minutes`` of ``trip_distance_speed``.

    Miles and speed leave out trips without distance.
    """
    moved = F.col("miles") > 0
    return measured.groupBy("bike_type").agg(
        F.avg(F.when(moved, F.col("miles"))).alias("avg_miles"),
        F.avg(F.when(moved, F.col("mph"))).alias("avg_mph"),
        F.avg(F.when(F.col("minutes") > 0, F.col("minutes"))).alias("avg_minutes"),
    )


def daily_distance_speed(measured: DataFrame) -> DataFrame:
    """``date, bike_type, avg_miles, avg_mph``, with the trips without distance."""
    return measured.groupBy("date", "bike_type").agg(
        F.avg("miles").alias("avg_miles"), F.avg("mph").alias("avg_mph")
    )


def density_curves(measured: DataFrame) -> DataFrame:
    """``measure, bike_type, point, x, density`` for miles, minutes and mph.

    Miles up to 5, minutes up to 60, and mph above 0 and below 15.5.
    """
    limits = {
        "miles": DENSITY_MAX_MILES,
        "minutes": DENSITY_MAX_MINUTES,
        "mph": DENSITY_MAX_MPH,
    }
    long = stack_rows(
        measured,
        ["bike_type"],
        [
            {"measure": F.lit(name), "value": F.col(name), "upper": F.lit(upper)}
            for name, upper in limits.items()
        ],
    )
    speed_kept = (F.col("value") > 0) & (F.col("value") < F.col("upper"))
    kept = F.when(F.col("measure") == "mph", speed_kept).otherwise(
        F.col("value") <= F.col("upper")
    )
    return curves(long.where(kept), ["measure", "bike_type"], "value", "upper")


def pair_distances(
    trips: DataFrame, stations: DataFrame, first: dt.date, member_type: str = "Member"
) -> DataFrame:
    """``bike_type, miles, trips`` of each pair of stations.

    Distance depends on the pair alone, so trips are counted before the stations
    are looked up.
    """
    pairs = (
        within(trips, first)
        .where(forward() & by_member_type(member_type))
        .groupBy(bike_type("bike_number").alias("bike_type"), "start_station", "end_station")
        .agg(F.count("*").alias("trips"))
    )
    return with_end_points(pairs, stations, "lat", "lon", salts=1).select(
        "bike_type", miles_between_ends().alias("miles"), "trips"
    )


def distance_density(counted: DataFrame) -> DataFrame:
    """``bike_type, point, x, density`` for miles of any length, of ``bike_type, miles, trips``."""
    return counted_density_curves(counted, ["bike_type"], "miles", "trips")
