"""Weekday trips by the operating hours of another service."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spokeworks.functions.classify import trip_type
from spokeworks.functions.durations import US_PER_HOUR, day_of_week, time_of_day_us
from spokeworks.operators.lookup import attach
from spokeworks.plans.selections import within
from spokeworks.schemas import SERVICE_STATUS_LABELS


def trips_by_service_hours(
    trips: DataFrame, service_hours: DataFrame, first: dt.date, small: bool | None = None
) -> DataFrame:
    """``trip_type, day_of_week, op_status, type_total, trips`` of Monday to Friday.

    Both bounds of a period belong to it: a trip on a shared bound counts in both
    periods, and one outside all periods has neither day nor status. A trip of no
    type has no total. Each period is listed under every hour it
    touches, so that day and hour are join keys and only the periods of one
    hour are compared with a trip.
    """
    weekday = within(trips, first).where(day_of_week().between(1, 5)).select(
        trip_type("bike_number", "member_type").alias("trip_type"),
        day_of_week().alias("trip_dow"),
        time_of_day_us().alias("at_us"),
    )
    hour = F.floor(F.col("at_us") / US_PER_HOUR)
    touched = F.sequence(
        F.floor(F.col("start_us") / US_PER_HOUR), F.floor(F.col("end_us") / US_PER_HOUR)
    )
    by_hour = (
        service_hours.where(F.col("start_us") <= F.col("end_us"))
        .select("day_of_week", "op_status", "start_us", "end_us")
        .withColumn("period_hour", F.explode(touched))
    )
    counts = (
        attach(
            weekday.withColumn("trip_hour", hour),
            by_hour,
            {"trip_dow": "day_of_week", "trip_hour": "period_hour"},
            F.col("at_us").between(F.col("start_us"), F.col("end_us")),
            small=small,
        )
        .groupBy("trip_type", "day_of_week", "op_status")
        .agg(F.count("*").alias("trips"))
    )
    total = F.sum("trips").over(Window.partitionBy("trip_type"))
    return counts.select(
        "trip_type",
        "day_of_week",
        "op_status",
        F.when(F.col("trip_type").isNotNull(), total).alias("type_total"),
        "trips",
    ).orderBy(*[F.asc_nulls_last(c) for c in ("trip_type", "day_of_week", "op_status")])


def service_hours_share(
    counts: DataFrame, labels: dict[str, str] = SERVICE_STATUS_LABELS
) -> DataFrame:
    """``trips_by_service_hours`` with each row's share of its type's total and a
    readable status; a status without a label becomes NULL."""
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return counts.withColumns(
        {
            "trip_share": F.try_divide("trips", "type_total"),
            "op_status": F.try_element_at(names, F.col("op_status")),
        }
    )
