"""Station and route rankings. ``short_name`` is the key of the station table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spokeworks.functions.classify import known_bike_type
from spokeworks.functions.geo import great_circle_miles
from spokeworks.operators.lookup import SALTS, attach, fits_broadcast
from spokeworks.operators.ranking import top_n
from spokeworks.plans.selections import by_member_type, forward, within


def trips_by_station(
    trips: DataFrame, stations: DataFrame, first: dt.date, member_type: str
) -> DataFrame:
    """``member_type, start_station, start_name, total_trips``, busiest first.

    Trips are counted before the names are looked up, so the join sees one row
    per station.
    """
    totals = (
        within(trips, first)
        .where(forward() & by_member_type(member_type))
        .groupBy("start_station")
        .agg(F.count("*").alias("total_trips"))
    )
    names = stations.select(
        F.col("short_name").alias("_station"), F.col("name").alias("start_name")
    )
    return (
        attach(totals, names, {"start_station": "_station"}, salts=1)
        .select(
            F.lit(member_type).alias("member_type"), "start_station", "start_name", "total_trips"
        )
        .orderBy(F.desc("total_trips"), F.asc_nulls_last("start_station"))
    )


def end_points(stations: DataFrame, side: str, *columns: str) -> DataFrame:
    """Station columns named for one end of a trip, beside the key ``_{side}``."""
    return stations.select(
        F.col("short_name").alias(f"_{side}"),
        *[F.col(c).alias(f"{side}_{c}") for c in columns],
    )


def with_end_points(
    trips: DataFrame,
    stations: DataFrame,
    *columns: str,
    small: bool | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Add station ``columns`` for both ends; an unknown station leaves NULLs.

    ``salts=1`` for counted trips, see ``attach``.
    """
    if small is None and salts > 1:
        small = fits_broadcast(stations.select("short_name", *columns))
    out = trips
    for side in ("start", "end"):
        points = end_points(stations, side, *columns)
        keys = {f"{side}_station": f"_{side}"}
        out = attach(out, points, keys, small=small, salts=salts).drop(f"_{side}")
    return out


def miles_between_ends() -> Column:
    return great_circle_miles(*[F.col(c) for c in ("start_lat", "start_lon", "end_lat", "end_lon")])


def top_routes(
    trips: DataFrame,
    stations: DataFrame,
    first: dt.date,
    member_type: str = "Member",
    n: int = 10,
) -> DataFrame:
    """The ``n`` busiest start-end pairs of each bike type, with names and distance.

    Ties are broken by start, then end station. Stations are looked up for the
    ``n`` ranked pairs only.
    """
    pairs = (
        within(trips, first)
        .where(forward() & by_member_type(member_type))
        .withColumn("bike_type", known_bike_type("bike_number"))
        .where(F.col("bike_type").isNotNull())
        .groupBy("bike_type", "start_station", "end_station")
        .agg(F.count("*").alias("total_trips"))
    )
    order = [
        F.desc("total_trips"),
        F.asc_nulls_last("start_station"),
        F.asc_nulls_last("end_station"),
    ]
    return (
        with_end_points(
            top_n(pairs, ["bike_type"], order, n), stations, "name", "lat", "lon", salts=1
        )
        .withColumn("miles", miles_between_ends())
        .orderBy("bike_type", *order)
    )
