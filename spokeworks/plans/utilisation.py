"""Trips per bike, by fleet and by bikes used, beside the chance of rain."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spokeworks.functions.classify import CLASSIC, PLUS
from spokeworks.operators.lookup import attach
from spokeworks.operators.reshape import stack_rows
from spokeworks.plans.fleet import calendar_use, with_fleet
from spokeworks.plans.history import History


def daily_utilisation(
    trips: DataFrame,
    weather: DataFrame,
    first: dt.date,
    last: dt.date,
    from_day: dt.date | None = None,
    kept: History | None = None,
) -> DataFrame:
    """Each calendar day: chance of rain, trips, bikes used and fleet by type."""
    rain = weather.where(F.col("weather_date").between(F.lit(first), F.lit(last))).select(
        "weather_date", F.col("precipprobability").alias("rain_probability")
    )
    use = calendar_use(trips, first, last, from_day or first, kept).drop("all_trips")
    # a row per day of the calendar on either side
    known = attach(use, rain, {"date": "weather_date"}, small=True)
    return with_fleet(known.drop("weather_date"), trips, kept)


def _per_bike_long(daily: DataFrame, bikes: str) -> DataFrame:
    def ratio(kind: str) -> Column:
        return F.try_divide(f"{kind}_trips", f"{kind}_{bikes}")

    return stack_rows(
        daily,
        ["date", "rain_probability"],
        [
            {"bike_type": F.lit(CLASSIC), "trips_per_bike": ratio("classic")},
            {"bike_type": F.lit(PLUS), "trips_per_bike": ratio("plus")},
        ],
    )


def trips_per_fleet_bike_long(daily: DataFrame) -> DataFrame:
    """``date, rain_probability, bike_type, trips_per_bike`` by fleet size.

    ``daily`` is the result of ``daily_utilisation``.
    """
    return _per_bike_long(daily, "fleet")


def trips_per_used_bike_long(daily: DataFrame) -> DataFrame:
    """The same, by bikes with at least one trip on the day."""
    return _per_bike_long(daily, "used")


def overall_trips_per_bike(daily: DataFrame) -> DataFrame:
    """One row: total trips over total bike days, by type and by fleet or use."""

    def ratio(kind: str, bikes: str) -> Column:
        share = F.try_divide(F.sum(f"{kind}_trips"), F.sum(f"{kind}_{bikes}"))
        return share.alias(f"{kind}_trips_per_{bikes}_bike")

    return daily.agg(
        ratio("classic", "fleet"),
        ratio("plus", "fleet"),
        ratio("classic", "used"),
        ratio("plus", "used"),
    )
