from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from spokeworks.functions.classify import bike_type, is_classic, known_bike_type, trip_type
from spokeworks.functions.durations import (
    day_of_week,
    elapsed_us,
    first_of_next_month,
    mean_seconds,
    time_of_day_us,
)
from spokeworks.functions.geo import great_circle_miles
from spokeworks.sources.trips import parse_timestamp


def test_bike_type_forms_differ_on_missing_numbers(spark):
    df = spark.createDataFrame(
        [("W1",), ("w1",), ("?1",), ("Z1",), ("E1",), ("z1",), ("",), (None,)], "b STRING"
    )
    rows = df.select(
        "b", bike_type("b").alias("t"), known_bike_type("b").alias("k"), is_classic("b").alias("c")
    ).collect()
    got = {r["b"]: (r["t"], r["k"], r["c"]) for r in rows}
    for b in ("W1", "w1", "?1", "Z1"):
        assert got[b] == ("Classic", "Classic", True)
    for b in ("E1", "z1", ""):
        assert got[b] == ("Plus", "Plus", False)
    assert got[None] == ("Plus", None, None)


def test_trip_type_leaves_other_combinations_without_type(spark):
    df = spark.createDataFrame(
        [
            ("W1", "Member"),
            ("W1", "Casual"),
            ("W1", "Other"),
            ("W1", None),
            ("E1", "Other"),
            (None, "Member"),
        ],
        "b STRING, m STRING",
    )
    got = [r[0] for r in df.select(trip_type("b", "m")).collect()]
    assert got == ["Classic, Member", "Classic, Casual", None, None, "Plus", None]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_spans_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # New York skips 02:00-03:00 on this day
        df = spark.sql(
            "SELECT timestamp_ntz'2018-03-11 01:59:59.999999' AS start_date,"
            " timestamp_ntz'2018-03-11 03:30:00' AS end_date"
        )
        row = df.select(
            elapsed_us().alias("us"), time_of_day_us("end_date").alias("tod"), day_of_week()
        ).first()
        assert row["us"] == 5_400_000_001
        assert row["tod"] == 12_600_000_000
        assert row[2] == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_negative_and_long_spans(spark):
    df = spark.sql(
        "SELECT timestamp_ntz'2018-01-01 00:00:01' AS start_date,"
        " timestamp_ntz'2018-01-01 00:00:00.5' AS end_date UNION ALL "
        "SELECT timestamp_ntz'1900-01-01 00:00:00', timestamp_ntz'2100-01-01 00:00:00.000001'"
    )
    got = [r[0] for r in df.select(elapsed_us()).collect()]
    days = (dt.date(2100, 1, 1) - dt.date(1900, 1, 1)).days
    assert got == [-500_000, days * 86_400_000_000 + 1]


def test_mean_seconds_is_exact_where_a_plain_sum_would_overflow(spark):
    near = 2**62 // 1_000_000 * 1_000_000
    df = spark.range(8).select(F.lit(near).alias("us"))
    assert df.agg(mean_seconds(F.col("us"))).first()[0] == near / 1e6
    df = spark.createDataFrame([(-1,), (1_500_000,), (None,)], "us BIGINT")
    assert df.agg(mean_seconds(F.col("us"))).first()[0] == pytest.approx(1_499_999 / 2e6, rel=1e-15)
    assert df.where("us > 9e9").agg(mean_seconds(F.col("us"))).first()[0] is None


def test_first_of_next_month(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2018, 9, 30, 23, 59),), (dt.datetime(2018, 12, 1),)], "t TIMESTAMP_NTZ"
    )
    got = [r[0] for r in df.select(first_of_next_month(F.col("t"))).collect()]
    assert got == [dt.date(2018, 10, 1), dt.date(2019, 1, 1)]


def test_great_circle_miles(spark):
    df = spark.createDataFrame(
        [
            (38.9, -77.0, 38.9, -77.0),
            (0.0, 0.0, 0.0, 180.0),
            (38.9072, -77.0369, 40.7128, -74.006),
            (None, -77.0, 38.9, -77.0),
        ],
        "a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE",
    )
    got = [r[0] for r in df.select(great_circle_miles(*[F.col(c) for c in "abcd"])).collect()]
    assert got[0] == 0.0
    assert got[1] == pytest.approx(math.pi * 6371.009 / 1.609344, rel=1e-12)
    lat1, lon1, lat2, lon2 = map(math.radians, (38.9072, -77.0369, 40.7128, -74.006))
    half = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin(
        (lon2 - lon1) / 2
    ) ** 2
    assert got[2] == pytest.approx(2 * math.asin(math.sqrt(half)) * 6371.009 / 1.609344, rel=1e-9)
    assert got[3] is None


def test_parse_timestamp_reads_both_spellings(spark):
    df = spark.createDataFrame(
        [("2018-09-05 00:00:01",), ("6/1/2014 00:00:02",), ("9/12/2014 7:05",), (None,)], "t STRING"
    )
    assert [r[0] for r in df.select(parse_timestamp(F.col("t"))).collect()] == [
        dt.datetime(2018, 9, 5, 0, 0, 1),
        dt.datetime(2014, 6, 1, 0, 0, 2),
        dt.datetime(2014, 9, 12, 7, 5),
        None,
    ]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        spark.createDataFrame([("soon",)], "t STRING").select(parse_timestamp(F.col("t"))).collect()
