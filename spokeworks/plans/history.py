"""What the reports need of a whole trips table, kept up to date with each append.

Four aggregates are kept beside the table, each merged with a cheaper one of its own kind:

- ``bikes``: a dense number for each bike;
- ``lives``: first and last trip of each bike (minimum, maximum);
- ``usage``: trips, time and members by day and bike type (sums);
- ``sets``: the bikes used by day and bike type, as bitmaps over their numbers (union).

A span of trip ids is read once, when it was appended. After that fleet sizes,
distinct bikes of any period, and daily and monthly counts don't read trips.

A table that is replaced year by year has no ids to go on from. Its ``lives`` are kept by
year, and a year's are made anew when the year is replaced.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spokeworks.functions.classify import CLASSIC, bike_type
from spokeworks.functions.durations import US_PER_SECOND, elapsed_us
from spokeworks.operators.staging import passing_copies, stage
from spokeworks.plans.selections import by_member_type
from spokeworks.schemas import BIKE_LIVES, BIKE_NUMBERS, DAILY_SETS, DAILY_USAGE, TRIPS
from spokeworks.sources import files, kept
from spokeworks.sources.tables import last_id, read_trips_table

#: Bits of one bitmap, as the bitmap functions have it.
BITS = 32_768
#: Buckets in which bikes are numbered, and in which numbers and lives are stored.
BUCKETS = 8
#: Spans that are merged into one once there are so many.
MOST_SPANS = 24

_PARTS = {"bikes": BIKE_NUMBERS, "lives": BIKE_LIVES, "usage": DAILY_USAGE, "sets": DAILY_SETS}
_LAST = "sets"  # written last: a span counts once this part of it is there


def _bucket() -> Column:
    return F.pmod(F.xxhash64("bike_number"), F.lit(BUCKETS)).cast("int")


def number_bikes(bikes: DataFrame, known: DataFrame) -> DataFrame:
    """``bike_number, bike_id, bucket`` of the bikes that ``known`` lacks.

    A bike is numbered within its hash bucket, after those that the bucket has, so
    the work is spread and numbers stay dense: each bucket fills one bitmap after the other.
    """
    fresh = bikes.select("bike_number").where("bike_number IS NOT NULL").distinct()
    fresh = fresh.join(known, "bike_number", "left_anti").withColumn("bucket", _bucket())
    taken = known.groupBy("bucket").agg(F.count("*").alias("taken"))
    order = Window.partitionBy("bucket").orderBy("bike_number")
    place = F.row_number().over(order) - 1 + F.coalesce("taken", F.lit(0).cast("bigint"))
    full = F.expr(f"_place div {BITS}") * BUCKETS + F.col("bucket")
    return (
        fresh.join(taken, "bucket", "left")
        .withColumn("_place", place.cast("bigint"))
        .select("bike_number", (full * BITS + F.col("_place") % BITS + 1).alias("bike_id"), "bucket")
    )


def by_day_and_bike(trips: DataFrame) -> DataFrame:
    """One row for each day and bike: all that the kept aggregates are made of."""
    us = elapsed_us()
    rest = F.pmod(us, F.lit(US_PER_SECOND))
    return trips.groupBy(F.to_date("start_date").alias("date"), "bike_number").agg(
        F.count("*").alias("trips"),
        F.min("start_date").alias("first_start"),
        F.max("start_date").alias("last_start"),
        F.sum(((us - rest) / US_PER_SECOND).cast("bigint")).alias("seconds"),
        F.sum(rest).alias("micros"),
        F.count(us).alias("timed"),
        F.count_if(by_member_type("Casual")).alias("casual"),
        F.count_if(by_member_type("Member")).alias("member"),
    )


def merged_lives(lives: DataFrame) -> DataFrame:
    return (
        lives.where("bike_number IS NOT NULL")
        .groupBy("bike_number")
        .agg(F.min("first_start").alias("first_start"), F.max("last_start").alias("last_start"))
    )


_SUMS = ("trips", "seconds", "micros", "timed", "casual", "member")


def _usage(days: DataFrame) -> DataFrame:
    return days.groupBy("date", "bike_type", "numbered").agg(*(F.sum(c).alias(c) for c in _SUMS))


def _merged_sets(sets: DataFrame) -> DataFrame:
    return sets.groupBy("date", "bike_type", "bitmap").agg(F.bitmap_or_agg("bikes").alias("bikes"))


def _path(table: str, part: str) -> str:
    return f"{table.rstrip('/')}_history/{part}"


@dataclass(frozen=True)
class History:
    """The kept aggregates of a trips table."""

    lives: DataFrame  # bike_number, first_start, last_start
    usage: DataFrame  # DAILY_USAGE, a row per day, type and span
    sets: DataFrame  # DAILY_SETS, a row per day, type, bitmap and span

    def used(self, *keys: str, where: Column | None = None) -> DataFrame:
        """Distinct bikes by ``keys``, columns of a day: the union of the days' bitmaps."""
        days = self.sets if where is None else self.sets.where(where)
        united = days.groupBy(*keys, "bitmap").agg(F.bitmap_or_agg("bikes").alias("bikes"))
        return united.groupBy(*keys).agg(F.sum(F.bitmap_count("bikes")).alias("bikes"))


def advance(spark: SparkSession, table: str) -> None:
    """Add what the stored trips have above the last id that the history covers.

    Run again it does nothing; after a job that died it writes the span anew. Trips
    that were stored before there was a history are one span more.
    """
    trips = read_trips_table(spark, table)
    upto = last_id(trips, "trip_id")
    chain, after = kept.spans(spark, _path(table, _LAST))
    if after is not None and after >= upto:
        return
    own = F.col("trip_id") <= upto
    if after is not None:
        own = own & (F.col("trip_id") > after)
    name = kept.span(after, upto)
    known = _read(spark, table, "bikes", chain)
    with passing_copies(spark):
        days = stage(by_day_and_bike(trips.where(own)), "history-days")
        kept.put(number_bikes(days, known), _path(table, "bikes"), kept.SPAN, name, "bucket")
        numbers = _read(spark, table, "bikes", [*chain, name]).select("bike_number", "bike_id")
        kept.put(merged_lives(days).withColumn("bucket", _bucket()), _path(table, "lives"), kept.SPAN, name, "bucket")
        typed = days.withColumns({"bike_type": bike_type("bike_number"), "numbered": F.col("bike_number").isNotNull()})
        kept.put(_usage(typed), _path(table, "usage"), kept.SPAN, name)
        sets = (
            typed.join(numbers, "bike_number")
            .groupBy("date", "bike_type", F.bitmap_bucket_number("bike_id").alias("bitmap"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bike_id")).alias("bikes"))
        )
        kept.put(sets, _path(table, "sets"), kept.SPAN, name)
    if len(chain) + 1 >= MOST_SPANS:
        compact(spark, table)


def compact(spark: SparkSession, table: str) -> None:
    """Merge all spans into one. Readers take it once it is whole; then the others go."""
    chain, upto = kept.spans(spark, _path(table, _LAST))
    if len(chain) < 2 or upto is None:
        return
    name = kept.span(None, upto)
    merged = {
        "bikes": _read(spark, table, "bikes", chain),
        "lives": merged_lives(_read(spark, table, "lives", chain)).withColumn("bucket", _bucket()),
        "usage": _usage(_read(spark, table, "usage", chain)),
        "sets": _merged_sets(_read(spark, table, "sets", chain)),
    }
    for part, df in merged.items():
        kept.put(df, _path(table, part), kept.SPAN, name, *(["bucket"] if "bucket" in df.columns else []))
    for part in merged:
        kept.drop_parts(spark, _path(table, part), kept.SPAN, chain)


def _read(spark: SparkSession, table: str, part: str, chain: list[str]) -> DataFrame:
    return kept.read_parts(spark, _path(table, part), _PARTS[part], kept.SPAN, chain)


def read_history(spark: SparkSession, table: str) -> History | None:
    """The history of a trips table; None if it has none or not of all its trips."""
    chain, upto = kept.spans(spark, _path(table, _LAST))
    if upto is None or upto != last_id(read_trips_table(spark, table), "trip_id"):
        return None
    return History(
        lives=merged_lives(_read(spark, table, "lives", chain)),
        usage=_read(spark, table, "usage", chain),
        sets=_read(spark, table, "sets", chain),
    )


YEAR = "year"
FILE_YEAR = "file_year"  # by which the table is stored


def forget_years(spark: SparkSession, table: str, years: list[int]) -> None:
    """Remove what is kept of years that are about to be replaced."""
    kept.drop_parts(spark, _path(table, "lives"), YEAR, [str(y) for y in years])


def keep_years(spark: SparkSession, table: str, years: list[int]) -> None:
    """First and last trip of each bike (and of trips without one) in each of the stored years.

    One job writes all years, each task a file for each year it has bikes of; a year counts
    once it is marked as finished.
    """
    shaped = T.StructType([*TRIPS.fields, T.StructField(FILE_YEAR, T.IntegerType())])
    (
        spark.read.schema(shaped)
        .parquet(table)
        .where(F.col(FILE_YEAR).isin(years))
        .groupBy(F.col(FILE_YEAR).alias(YEAR), "bike_number")
        .agg(F.min("start_date").alias("first_start"), F.max("start_date").alias("last_start"))
        .write.mode("append")
        .partitionBy(YEAR)
        .parquet(_path(table, "lives"))
    )
    for year in years:
        kept.mark(spark, _path(table, "lives"), YEAR, str(year))


def read_year_lives(spark: SparkSession, table: str) -> DataFrame | None:
    """``bike_number, first_start, last_start`` over all years; None if what is kept lacks a year."""
    stored = [n.partition("=")[2] for n in files.folder_names(spark, table) if n.startswith(f"{FILE_YEAR}=")]
    years = kept.finished(spark, _path(table, "lives"), YEAR)
    if not stored or stored != years:
        return None
    lives = kept.read_parts(spark, _path(table, "lives"), T.StructType(BIKE_LIVES.fields[:3]), YEAR, years)
    return lives.groupBy("bike_number").agg(
        F.min("first_start").alias("first_start"), F.max("last_start").alias("last_start")
    )


def daily_use(history: History, first: dt.date, last: dt.date | None = None) -> DataFrame:
    """``date, classic_trips, plus_trips, all_trips, classic_used, plus_used`` of the days of a period."""
    within = F.col("date") >= F.lit(first)
    if last is not None:
        within = within & (F.col("date") <= F.lit(last))
    classic, numbered = F.col("bike_type") == CLASSIC, F.col("numbered")

    def trips(of: Column, name: str) -> Column:
        return F.sum(F.when(of, F.col("trips")).otherwise(0)).alias(name)

    counts = (
        history.usage.where(within)
        .groupBy("date")
        .agg(
            trips(classic & numbered, "classic_trips"),
            trips(~classic & numbered, "plus_trips"),
            F.sum("trips").alias("all_trips"),
        )
    )
    used = (
        history.used("date", "bike_type", where=within)
        .groupBy("date")
        .agg(
            F.sum(F.when(classic, F.col("bikes"))).alias("classic_used"),
            F.sum(F.when(~classic, F.col("bikes"))).alias("plus_used"),
        )
    )
    zero = F.lit(0).cast("bigint")
    return counts.join(used, "date", "left").withColumns(
        {c: F.coalesce(c, zero) for c in ("classic_used", "plus_used")}
    )


def monthly_basic_stats(history: History, first: dt.date, by_year: bool = False) -> DataFrame:
    """What ``durations.monthly_basic_stats`` has, from the kept days."""
    keys = (["year"] if by_year else []) + ["month", "bike_type"]

    def dated(df: DataFrame) -> DataFrame:
        own = df.where(F.col("date") >= F.lit(first))
        return own.withColumns({"month": F.month("date"), "year": F.year("date")})

    sums = dated(history.usage).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in _SUMS))
    bikes = History(history.lives, history.usage, dated(history.sets)).used(*keys)
    return (
        sums.join(bikes, keys, "left")
        .select(
            *keys,
            "trips",
            F.coalesce("bikes", F.lit(0).cast("bigint")).alias("bikes"),
            F.try_divide(F.col("seconds") + F.col("micros") / US_PER_SECOND, "timed").alias("avg_seconds"),
            (F.col("member") / F.col("trips")).alias("member_share"),
            F.col("casual").alias("casual_trips"),
            F.col("member").alias("member_trips"),
        )
        .orderBy("bike_type", *[k for k in keys if k != "bike_type"])
    )
