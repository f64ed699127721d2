"""Saved API snapshots: stations, regions, daily weather."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spokeworks.operators.conform import conform, fill_missing, lower_names
from spokeworks.operators.reshape import literal_rows
from spokeworks.schemas import (
    DEFAULT_REGION_ID,
    REGION_CODES,
    STATIONS,
    WEATHER,
    WEATHER_RECORD,
)

_STATION_ENTRY = (
    "capacity INT, lat DOUBLE, lon DOUBLE, name STRING, region_id STRING, "
    "short_name STRING, station_id STRING"
)


def read_station_snapshot(
    spark: SparkSession, path: str, default_region: int = DEFAULT_REGION_ID
) -> DataFrame:
    """Stations in ``data.stations`` with ``position``, their place in the list."""
    document = f"data STRUCT<stations: ARRAY<STRUCT<{_STATION_ENTRY}>>>"
    listed = (
        spark.read.schema(document)
        .option("multiLine", True)
        .json(path)
        .select(F.posexplode("data.stations").alias("position", "s"))
        .select("position", "s.*")
    )
    region = F.coalesce(F.col("region_id").cast("int"), F.lit(default_region))
    return conform(
        listed.withColumn("region_id", region),
        T.StructType([*STATIONS.fields, T.StructField("position", T.IntegerType())]),
    )


def read_region_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """``region_id, name`` of the regions in ``data.regions``."""
    document = "data STRUCT<regions: ARRAY<STRUCT<region_id: STRING, name: STRING>>>"
    return (
        spark.read.schema(document)
        .option("multiLine", True)
        .json(path)
        .select(F.inline("data.regions"))
        .select(F.col("region_id").cast("int").alias("region_id"), "name")
    )


def region_codes(spark: SparkSession) -> DataFrame:
    """``name, code`` of the known regions."""
    return literal_rows(spark, ["name", "code"], list(REGION_CODES.items()))


def read_weather(
    spark: SparkSession,
    path: str,
    first: dt.date | None = None,
    last: dt.date | None = None,
    zone: str = "America/New_York",
) -> DataFrame:
    """Daily records ``daily.data[0]`` as rows of the weather table.

    A record's date is the local date of its ``time`` in ``zone``. Fields the
    table lacks are dropped; missing numbers become 0 and missing texts '0'.
    """
    stored = [f for f in WEATHER_RECORD if f.name != "weather_date"]
    record = T.StructType([*stored, T.StructField("time", T.LongType())])
    document = T.StructType(
        [
            T.StructField(
                "daily", T.StructType([T.StructField("data", T.ArrayType(record))])
            )
        ]
    )
    utc = F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, time)")
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    days = (
        spark.read.schema(document)
        .option("multiLine", True)
        .json(path)
        .select(F.get("daily.data", F.lit(0)).alias("record"))
        .select("record.*")
        .withColumn("weather_date", F.to_date(local))
    )
    if first is not None:
        days = days.where(F.col("weather_date") >= F.lit(first))
    if last is not None:
        days = days.where(F.col("weather_date") <= F.lit(last))
    return fill_missing(conform(lower_names(days), WEATHER))
