"""Dockless bikes and scooters from device locations."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spokeworks.functions.durations import elapsed_us, mean_seconds
from spokeworks.operators.reshape import literal_rows, stack_rows

KIND_PATH = "$.attributes.vehicle_type"


def with_kind(locations: DataFrame) -> DataFrame:
    """The location columns in use, with the document parsed at most once per row.

    A document without the tag's name is not parsed. A backslash may spell the name in
    another way, so such documents are parsed as well.
    """
    raw = F.col("raw")
    may_have = raw.contains("vehicle_type") | raw.contains("\\")
    kind = F.when(may_have, F.get_json_object(raw, KIND_PATH))
    return locations.select("created", "bike_id", "provider", kind.alias("kind"))


def tagged(kind: str) -> Column:
    return F.coalesce(F.col("kind") == kind, F.lit(False))


def daily_vehicle_kinds(locations: DataFrame, provider: str, bikes_before: dt.date) -> DataFrame:
    """``date, bikes, scooters, vehicles, unknown`` of one provider.

    A vehicle first seen before ``bikes_before``, or ever tagged so, is a bike; one
    ever tagged so is a scooter. ``unknown`` is what is left, and goes below
    zero when a vehicle is both.

    One scan: locations shrink to a row per day and vehicle before the
    shuffle, so a vehicle's window holds its days, however often it reports.
    """
    per_day = (
        with_kind(locations)
        .where(F.col("provider") == provider)
        .groupBy(F.to_date("created").alias("date"), "bike_id")
        .agg(
            F.bool_or(tagged("bike")).alias("bike"),
            F.bool_or(tagged("scooter")).alias("scooter"),
        )
    )
    life = Window.partitionBy("bike_id")
    early = F.coalesce(F.min("date").over(life) < F.lit(bikes_before), F.lit(False))
    known = F.col("bike_id").isNotNull()
    counts = (
        per_day.withColumns(
            {
                "ever_bike": early | F.bool_or("bike").over(life),
                "ever_scooter": F.bool_or("scooter").over(life),
            }
        )
        .groupBy("date")
        .agg(
            F.count_if(known & F.col("ever_bike")).alias("bikes"),
            F.count_if(known & F.col("ever_scooter")).alias("scooters"),
            F.count_if(known).alias("vehicles"),
        )
    )
    unknown = F.col("vehicles") - F.col("bikes") - F.col("scooters")
    return counts.withColumn("unknown", unknown).orderBy(F.asc_nulls_last("date"))


def vehicle_kinds_apportioned(daily: DataFrame) -> DataFrame:
    """``date, bikes, scooters``: the unknown shared out like the known, rounded
    toward zero; NULL on a day without known vehicles. Beside them ``known_bikes``,
    ``known_scooters``, ``vehicles`` and ``unknown`` as counted."""
    known = F.col("bikes") + F.col("scooters")

    def spread(kind: str) -> Column:
        part = F.try_divide(F.col(kind), known) * F.col("unknown")
        return (F.col(kind) + part).cast("bigint").alias(kind)

    return daily.select(
        "date",
        spread("bikes"),
        spread("scooters"),
        F.col("bikes").alias("known_bikes"),
        F.col("scooters").alias("known_scooters"),
        "vehicles",
        "unknown",
    )


def vehicle_kinds_long_events(
    apportioned: DataFrame, events: Sequence[tuple[dt.date, str, str]]
) -> DataFrame:
    """``date, vehicle, on_street, event``; '' where nothing happened.

    ``events`` is a written-out list of ``(date, vehicle, event)``, which is why it may
    be broadcast.
    """
    long = stack_rows(
        apportioned,
        ["date"],
        [
            {"vehicle": F.lit(kind), "on_street": F.col(kind)}
            for kind in ("bikes", "scooters")
        ],
    )
    if not events:
        return long.withColumn("event", F.lit(""))
    noted = literal_rows(apportioned.sparkSession, ["date", "vehicle", "event"], events)
    return long.join(F.broadcast(noted), ["date", "vehicle"], "left").withColumn(
        "event", F.coalesce("event", F.lit(""))
    )


def total_scooters(locations: DataFrame) -> DataFrame:
    """One row: vehicles of any provider ever tagged as scooter."""
    tagged = with_kind(locations).where(F.col("kind") == "scooter")
    return tagged.agg(F.countDistinct("bike_id").alias("scooters"))


def total_vehicles(locations: DataFrame, provider: str) -> DataFrame:
    """One row: vehicles of one provider."""
    return locations.where(F.col("provider") == provider).agg(
        F.countDistinct("bike_id").alias("vehicles")
    )


def avg_vehicle_age(locations: DataFrame, provider: str, first_seen_by: dt.datetime) -> DataFrame:
    """One row: mean time between first and last location of the scooters first
    seen by a moment, in days.

    The tag may come from any provider, the locations from one. Both are found
    in one pass over the locations.
    """
    seen = F.when(F.col("provider") == provider, F.col("created"))
    # as text, so that the session's time zone has no say
    limit = F.lit(first_seen_by.isoformat(sep=" ")).cast("timestamp_ntz")
    return (
        with_kind(locations)
        .where(F.col("bike_id").isNotNull())
        .groupBy("bike_id")
        .agg(
            F.min(seen).alias("first_seen"),
            F.max(seen).alias("last_seen"),
            F.bool_or(tagged("scooter")).alias("scooter"),
        )
        .where(F.col("scooter") & (F.col("first_seen") <= limit))
        .agg((mean_seconds(elapsed_us("first_seen", "last_seen")) / 86_400).alias("avg_days"))
    )
