"""Trips, stations, locations and so on, derived from whole driver tables.

``checks/oracle.py`` states the same views in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Columns in use. With them given, no file is opened just to learn its schema.
_COLUMNS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
    "value DOUBLE, props STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderdate TIMESTAMP_NTZ",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_quantity DOUBLE, "
    "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS trip_id",
        "CAST(floor(value * 20) AS INT) - 200 AS duration",
        "ts AS start_date",
        "ts + make_dt_interval(0, 0, 0, CAST(floor(value * 20) AS INT) - 200) AS end_date",
        "CAST(CAST(get_json_object(props, '$.k') AS INT) % 30 AS STRING) AS start_station",
        "CAST(event_id % 30 AS STRING) AS end_station",
        "CASE WHEN user_id % 50 = 49 THEN NULL ELSE concat(CASE user_id % 6 WHEN 0 THEN 'W' "
        "WHEN 1 THEN 'w' WHEN 2 THEN '?' WHEN 3 THEN 'Z' WHEN 4 THEN 'E' ELSE '' END, "
        "CAST(user_id AS STRING)) END AS bike_number",
        "CASE event_type WHEN 'signup' THEN 'Casual' WHEN 'error' THEN 'Other' "
        "ELSE 'Member' END AS member_type",
    )


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(
        "CAST(n_nationkey + 10 AS INT) AS capacity",
        # one station lies far from all others, where the equator meets the first meridian
        "CASE WHEN n_nationkey = 24 THEN 0.0D"
        " ELSE CAST(38.80 + n_nationkey * 0.01 AS DOUBLE) END AS lat",
        "CASE WHEN n_nationkey = 24 THEN 0.0D"
        " ELSE CAST(-77.20 + ((n_nationkey * 7) % 25) * 0.01 AS DOUBLE) END AS lon",
        "n_name AS name",
        "n_regionkey AS region_id",
        "CAST(n_nationkey AS STRING) AS short_name",
        "n_nationkey AS station_id",
    )


def stored_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "CAST(s_suppkey % 40 AS INT) AS capacity",
        "CAST(38.0 + (s_suppkey % 90) * 0.01 AS DOUBLE) AS lat",
        "CAST(-77.0 - (s_suppkey % 80) * 0.01 AS DOUBLE) AS lon",
        "s_name AS name",
        "CAST(s_nationkey AS INT) AS region_id",
        "CAST(s_suppkey AS STRING) AS short_name",
        "CAST(1000 + s_suppkey AS INT) AS station_id",
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per day with events; the chance of rain is the day's share of errors."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.expr("CAST(ts AS DATE) AS weather_date"))
        .agg(F.expr("count_if(event_type = 'error') / count(*) AS precipprobability"))
    )


def service_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five periods on each of five days. One bound is shared, two are a second apart,
    and the last hours of the day are uncovered."""
    return table(spark, sf_dir, "nation").selectExpr(
        "CAST(n_nationkey DIV 5 + 1 AS INT) AS day_of_week",
        "CAST(element_at(array(0, 18000, 34200, 54000, 68401), n_nationkey % 5 + 1) AS BIGINT)"
        " * 1000000 AS start_us",
        "CAST(element_at(array(17999, 34200, 54000, 68400, 84600), n_nationkey % 5 + 1)"
        " AS BIGINT) * 1000000 AS end_us",
        "element_at(array('no_service', 'peak', 'regular', 'peak', 'regular'),"
        " n_nationkey % 5 + 1) AS op_status",
    )


def bike_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vehicle per user that is swapped for another twice, on days that differ by user."""
    return table(spark, sf_dir, "events").selectExpr(
        "ts AS created",
        "concat('v', CAST(user_id AS STRING), '-',"
        " CAST((day(ts) + user_id % 9) DIV 13 AS STRING)) AS bike_id",
        "CASE WHEN user_id % 10 = 9 THEN 'other' ELSE 'main' END AS provider",
        "CASE WHEN user_id % 3 = 0 AND event_type = 'click'"
        " THEN '{\"attributes\":{\"vehicle_type\":\"scooter\"}}'"
        " WHEN user_id % 3 = 1 AND event_type <> 'view'"
        " THEN '{\"attributes\":{\"vehicle_type\":\"bike\"}}'"
        " ELSE '{\"attributes\":{}}' END AS raw",
    )


def long_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second trip system, over several years.

    Both tables are joined in their own narrow types; texts are made after that. Orders that
    are few by the size of their file aren't in memory, so they are never broadcast.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem")
    return lines.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "CAST(l_quantity AS INT) AS duration",
        "o_orderdate AS start_date",
        "l_shipdate AS end_date",
        "CAST(l_suppkey AS STRING) AS start_station",
        "CAST(l_partkey AS STRING) AS end_station",
        "CAST(o_custkey AS STRING) AS bike_number",
        "CASE l_linestatus WHEN 'O' THEN 'Subscriber' ELSE 'Customer' END AS member_type",
    )
