"""One entry per analysis and ingest job, over whole driver tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import views
from spokeworks import jobs
from spokeworks.operators.conform import key_violations, repeated_keys
from spokeworks.operators.staging import staging_path
from spokeworks.plans import history, ingest, service_hours, vehicles
from spokeworks.plans.history import History
from spokeworks.plans.vehicle_history import VehicleHistory
from spokeworks.reports import REPORTS, Report, Study
from spokeworks.schemas import (
    EBIKES,
    NUMBERED_TRIPS,
    REGIONS,
    STATION_ID_LAYOUT,
    STATION_NUMBER_LAYOUT,
    STATIONS,
    TRIPS,
    WEATHER,
    TripLayout,
)
from spokeworks.sources import tables
from spokeworks.sources.trips import read_trips

Query = Callable[[SparkSession, str], DataFrame]

# The whole span of the driver's tables. The calendar goes on past the last trip.
FIRST = dt.date(2024, 1, 1)
LAST = dt.date(2024, 2, 5)
LONG_FIRST = dt.date(1995, 1, 1)
LONG_LAST = dt.date(2001, 12, 31)

# The window of first trips that makes a bike an e-bike.
EBIKE_FIRST = dt.date(1995, 6, 1)
EBIKE_LAST = dt.date(1995, 8, 31)

PROVIDER = "main"
BIKES_BEFORE = dt.date(2024, 1, 8)
SEEN_BY = dt.datetime(2024, 1, 25)
# Trips up to here are taken as stored, later ones as a new drop.
STORED_UNTIL = dt.date(2024, 1, 15)
SECOND_DROP = dt.date(2024, 1, 6)

EVENTS = (
    (dt.date(2024, 1, 3), "scooters", "introduced"),
    (dt.date(2024, 1, 12), "scooters", "extended"),
    (dt.date(2024, 1, 12), "bikes", "fewer"),
    (dt.date(2024, 3, 1), "scooters", "out of range"),
)


@dataclass(frozen=True)
class Views:
    """The driver's tables in the role of the tables the reports read."""

    spark: SparkSession
    sf_dir: str

    def trips(self) -> DataFrame:
        return views.trips(self.spark, self.sf_dir)

    def stations(self) -> DataFrame:
        return views.stations(self.spark, self.sf_dir)

    def weather(self) -> DataFrame:
        return views.weather(self.spark, self.sf_dir)

    def service_hours(self) -> DataFrame:
        return views.service_hours(self.spark, self.sf_dir)

    def bike_locations(self) -> DataFrame:
        return views.bike_locations(self.spark, self.sf_dir)

    def second_trips(self) -> DataFrame:
        return views.long_trips(self.spark, self.sf_dir)

    def ebikes(self) -> DataFrame:
        return _build_ebike_table(self.spark, self.sf_dir)

    def history(self) -> History | None:
        return None

    def second_lives(self) -> DataFrame | None:
        return None

    def vehicle_history(self, bikes_before: dt.date) -> VehicleHistory | None:
        return None


@dataclass(frozen=True)
class KeptViews(Views):
    """The same, with the aggregates that are kept beside stored tables.

    ``trips`` was stored in three appends, ``bike_locations`` in three batches that each have a
    part of every vehicle's locations, so that tags and first sightings come late.
    """

    def trips(self) -> DataFrame:
        return tables.read_trips_table(self.spark, self.trips_table())

    def history(self) -> History:
        kept = history.read_history(self.spark, self.trips_table())
        if kept is None:
            raise ValueError("the history lacks trips")
        return kept

    def second_trips(self) -> DataFrame:
        return tables.read_table(self.spark, self._years(), TRIPS)

    def second_lives(self) -> DataFrame:
        lives = history.read_year_lives(self.spark, self._years())
        if lives is None:
            raise ValueError("a year lacks its bikes")
        return lives

    def _years(self) -> str:
        store = lambda table: _store_years(self.spark, self.sf_dir, table)
        return _once(self.spark, self.sf_dir, "years-table", store)

    def vehicle_history(self, bikes_before: dt.date) -> VehicleHistory:
        path = _once(self.spark, self.sf_dir, "locations-table", self._store_locations)
        return ingest.vehicle_history(self.spark, path, bikes_before)

    def trips_table(self) -> str:
        return _once(self.spark, self.sf_dir, "kept-trips-table", self._store_trips)

    def _store_trips(self, table: str) -> None:
        trips = views.trips(self.spark, self.sf_dir)
        day = F.to_date("start_date")
        bounds = [None, SECOND_DROP, STORED_UNTIL, None]
        for after, until in zip(bounds, bounds[1:], strict=False):
            part = trips
            if after is not None:
                part = part.where(day >= F.lit(after))
            if until is not None:
                part = part.where(day < F.lit(until))
            drop = _write_drop(part, STATION_NUMBER_LAYOUT, STATION_NUMBER_HEADER)
            ingest.append_trips(self.spark, drop, table)

    def _store_locations(self, table: str) -> None:
        rows = views.bike_locations(self.spark, self.sf_dir)
        place = F.pmod(F.xxhash64("created", "bike_id"), F.lit(3))
        for n in range(3):
            drop = staging_path(self.spark, "locations")
            tables.export_csv(rows.where(place == n), drop, "|")
            ingest.add_locations(self.spark, drop, table, BIKES_BEFORE)


_STORED: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, store: Callable[[str], None]) -> str:
    """A table that several queries read, stored by the first of them in an application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = staging_path(spark, name)
        store(path)
        _STORED[key] = path
    return _STORED[key]


STUDY = Study(
    first=FIRST,
    last=LAST,
    fleet_first=FIRST,
    fleet_last=LAST,
    second_first=LONG_FIRST,
    second_last=LONG_LAST,
    ebike_first=EBIKE_FIRST,
    ebike_last=EBIKE_LAST,
    provider=PROVIDER,
    bikes_before=BIKES_BEFORE,
    seen_by=SEEN_BY,
    events=EVENTS,
)


def _reported(report: Report) -> Query:
    return lambda spark, sf: report(Views(spark, sf), STUDY)


def _reported_kept(report: Report) -> Query:
    return lambda spark, sf: report(KeptViews(spark, sf), STUDY)


#: Reports that take kept aggregates in place of the tables.
KEPT = (
    "monthly_basic_stats",
    "daily_fleet_calendar",
    "daily_fleet_trip_days",
    "daily_utilisation",
    "trips_per_fleet_bike_long",
    "trips_per_used_bike_long",
    "overall_trips_per_bike",
    "fleet_vs_trip_share",
    "fleet_vs_trip_share_long",
    "ebike_fleet_calendar",
    "first_seen_in_window",
    "daily_vehicle_kinds",
    "vehicle_kinds_apportioned",
    "vehicle_kinds_long_events",
    "total_scooters",
    "total_vehicles",
    "avg_vehicle_age",
)


# --- ingest: Spark first writes a driver table the way a raw drop would look -------


STATION_NUMBER_HEADER = [
    "Duration", "Start date", "End date", "Start station number", "Start station",
    "End station number", "End station", "Bike number", "Member type",
]
STATION_ID_HEADER = [
    "tripduration", "starttime", "stoptime", "start station id", "start station name",
    "start station latitude", "start station longitude", "end station id", "end station name",
    "end station latitude", "end station longitude", "bikeid", "usertype", "birth year", "gender",
]


def _write_drop(trips: DataFrame, layout: TripLayout, header: list[str]) -> str:
    """CSV files whose name and row order is the order of ``trip_id``."""
    path = staging_path(trips.sparkSession, "drop")
    source_of = {source: name for name, source in layout.columns(header).items()}
    ordered = trips.repartitionByRange("trip_id").sortWithinPartitions("trip_id")
    ordered.select(
        *[
            F.col(source_of[h]).cast("string").alias(h) if h in source_of else F.lit("x").alias(h)
            for h in header
        ]
    ).write.option("header", True).csv(path)
    return path


def _ingest_station_number_layout(spark: SparkSession, sf: str) -> DataFrame:
    drop = _write_drop(views.trips(spark, sf), STATION_NUMBER_LAYOUT, STATION_NUMBER_HEADER)
    return read_trips(spark, drop, STATION_NUMBER_LAYOUT)


def _ingest_station_id_layout(spark: SparkSession, sf: str) -> DataFrame:
    trips = views.long_trips(spark, sf).withColumn("trip_id", F.col("start_date"))
    drop = _write_drop(trips, STATION_ID_LAYOUT, STATION_ID_HEADER)
    return read_trips(spark, drop, STATION_ID_LAYOUT)


def _append_trips(spark: SparkSession, sf: str, runs: int = 1) -> DataFrame:
    trips = views.trips(spark, sf)
    table = staging_path(spark, "trips-table")
    stored = trips.where(F.col("start_date") < F.lit(STORED_UNTIL))
    tables.append_trips_table(stored, table)
    new = trips.where(F.col("start_date") >= F.lit(STORED_UNTIL))
    drop = _write_drop(new, STATION_NUMBER_LAYOUT, STATION_NUMBER_HEADER)
    for _ in range(runs):
        ingest.append_trips(spark, drop, table, keep=False)
    return tables.read_table(spark, table, NUMBERED_TRIPS)


def _append_trips_again(spark: SparkSession, sf: str) -> DataFrame:
    """The same drop appended twice, as by a job that is run again: it is added once."""
    return _append_trips(spark, sf, runs=2)


#: Why the line of a trip is none, by the remainder of the id.
DAMAGE = {7: "fields", 8: "fields", 9: "duration", 10: "start_date", 11: "end_date"}
DAMAGE_EVERY = 40


def _damaged_line(first: str, last: str) -> str:
    """SQL for a line of a trip file; ``first`` and ``last`` write the two timestamps."""
    of = f"trip_id % {DAMAGE_EVERY}"
    return (
        f"concat(CASE {of} WHEN 9 THEN 'n/a' ELSE CAST(duration AS STRING) END, ',',"
        f" CASE {of} WHEN 10 THEN 'soon' ELSE {first} END, ',',"
        f" CASE {of} WHEN 11 THEN '13/45/2024 9:00' ELSE {last} END, ',',"
        " coalesce(start_station, ''), ',x,', end_station, ',x',"
        f" CASE {of} WHEN 7 THEN '' WHEN 8 THEN concat(',', coalesce(bike_number, ''), ',', member_type, ',y')"
        " ELSE concat(',', coalesce(bike_number, ''), ',', member_type) END)"
    )


def _append_damaged(spark: SparkSession, sf: str, table: str) -> None:
    """Add a drop with lines that are no trips."""
    ordered = views.trips(spark, sf).repartitionByRange("trip_id").sortWithinPartitions("trip_id")
    line = F.expr(_damaged_line("date_format(start_date, 'M/d/yyyy H:mm:ss')", "CAST(end_date AS STRING)"))
    top = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    lines = F.when(top, F.array(F.lit(",".join(STATION_NUMBER_HEADER)), line)).otherwise(F.array(line))
    drop = staging_path(spark, "drop")
    # one column of raw lines: with neither separators nor quotes
    ordered.select(F.explode(lines)).write.options(sep="\x01", quote="").csv(drop)
    ingest.append_trips(spark, drop, table, most_bad=0.2, keep=False)


def _checked(spark: SparkSession, sf: str) -> str:
    return _once(spark, sf, "checked-table", lambda path: _append_damaged(spark, sf, path))


def _append_checked_trips(spark: SparkSession, sf: str) -> DataFrame:
    """The trips of a drop with lines that are none; ids are without gaps."""
    return tables.read_table(spark, _checked(spark, sf), NUMBERED_TRIPS)


def _rejected_trips(spark: SparkSession, sf: str) -> DataFrame:
    """The lines that were refused, and why."""
    return spark.read.parquet(ingest.rejected_path(_checked(spark, sf))).select("reason", "record")


def _stored_last_trip_id(spark: SparkSession, sf: str) -> DataFrame:
    """The last id of the stored trips, from the footers of their files."""
    last = tables.largest_stored(spark, KeptViews(spark, sf).trips_table(), "trip_id")
    return last.withColumnRenamed("id", "last_id")


def _appended_key_check(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that a new part of the trips repeats, within itself or from the stored part."""
    trips = views.trips(spark, sf)
    new = F.col("start_date") >= F.lit(STORED_UNTIL)
    return repeated_keys(trips.where(new), trips.where(~new), ["bike_number", "start_station"])


def _store_years(spark: SparkSession, sf: str, table: str) -> None:
    trips = views.long_trips(spark, sf)
    source_of = {v: k for k, v in STATION_ID_LAYOUT.columns(STATION_ID_HEADER).items()}
    drop = staging_path(spark, "drop")
    trips.select(
        F.year("start_date").alias("of"),
        *[F.col(source_of[h]).cast("string").alias(h) for h in STATION_ID_LAYOUT.kept],
    ).write.option("header", True).partitionBy("of").csv(drop)
    years = range(LONG_FIRST.year, LONG_LAST.year + 1)
    ingest.ingest_trips_by_year(spark, drop, table, years)


def _ingest_trips_by_year(spark: SparkSession, sf: str) -> DataFrame:
    table = staging_path(spark, "years-table")
    _store_years(spark, sf, table)
    return spark.read.parquet(table)


def _last_trip_id(spark: SparkSession, sf: str) -> DataFrame:
    last = tables.last_id(views.trips(spark, sf), "trip_id")
    return spark.range(1).select(F.lit(last).cast("bigint").alias("last_id"))


def _write_snapshot(entries: DataFrame, name: str) -> str:
    """One document ``{data: {name: [...]}}``; used for tables of fixed size only."""
    path = staging_path(entries.sparkSession, name)
    listed = F.sort_array(F.collect_list(F.struct(*entries.columns)))
    entries.agg(F.struct(listed.alias(name)).alias("data")).write.json(path)
    return path


def _upsert_stations(spark: SparkSession, sf: str) -> DataFrame:
    table = staging_path(spark, "stations-table")
    tables.replace_table(views.stored_stations(spark, sf), table, STATIONS)
    snapshot = views.stations(spark, sf).withColumn(
        "region_id", F.when(F.col("region_id") > 0, F.col("region_id"))
    )
    ingest.upsert_stations(spark, _write_snapshot(snapshot, "stations"), table)
    return tables.read_table(spark, table, STATIONS)


def _ingest_regions(spark: SparkSession, sf: str) -> DataFrame:
    named = F.expr(
        "CASE r_regionkey WHEN 0 THEN 'Washington, DC' WHEN 1 THEN 'Arlington, VA' "
        "WHEN 2 THEN 'Fairfax, VA' ELSE r_name END"
    )
    regions = views.table(spark, sf, "region").select(
        F.col("r_regionkey").alias("region_id"), named.alias("name")
    )
    table = staging_path(spark, "regions-table")
    ingest.ingest_regions(spark, _write_snapshot(regions, "regions"), table)
    return tables.read_table(spark, table, REGIONS)


def _ingest_weather(spark: SparkSession, sf: str) -> DataFrame:
    """Daily records with three of the stored fields and one the table lacks."""
    days = F.datediff("weather_date", F.lit(dt.date(1970, 1, 1)))
    record = F.struct(
        (days * 86_400 + 5 * 3_600).alias("time"),
        F.col("precipprobability").alias("precipProbability"),
        F.when(F.day("weather_date") % 2 == 0, "rain").alias("precipType"),
        F.concat(F.lit("day "), F.day("weather_date")).alias("summary"),
        F.lit(3).alias("uvIndex"),
    )
    drop = staging_path(spark, "weather")
    (
        views.weather(spark, sf)
        .select(F.struct(F.array(record).alias("data")).alias("daily"), "weather_date")
        .repartition("weather_date")
        .write.option("maxRecordsPerFile", 1)
        .partitionBy("weather_date")
        .json(drop)
    )
    table = staging_path(spark, "weather-table")
    ingest.ingest_weather(spark, f"{drop}/*", table, FIRST, LAST)
    return tables.read_table(spark, table, WEATHER).select(
        "weather_date", "precipprobability", "preciptype", "summary", "day_time", "windspeed"
    )


def _build_ebike_table(spark: SparkSession, sf: str) -> DataFrame:
    table = staging_path(spark, "ebikes-table")
    ingest.build_ebike_table(views.long_trips(spark, sf), table, EBIKE_FIRST, EBIKE_LAST)
    return tables.read_table(spark, table, EBIKES)


def _bulk_copy(spark: SparkSession, sf: str) -> DataFrame:
    trips = views.trips(spark, sf).select(*NUMBERED_TRIPS.names)
    table = staging_path(spark, "copied-table")
    ingest.bulk_copy(trips, staging_path(spark, "export"), table)
    return tables.read_table(spark, table, trips.schema)


#: Pieces of text that delimited files easily lose.
AWKWARD = (" both ", "\\N", "a,b", 'say "x"', "", "tab\there", "a|b", " ", '"', "#", "NULL")


def _export_texts(spark: SparkSession, sf: str) -> DataFrame:
    """A comma export with texts that are easily lost, read back."""
    choices = F.array(*(F.lit(x) for x in AWKWARD), F.lit(None))
    piece = F.element_at(choices, (F.col("event_id") % (len(AWKWARD) + 1) + 1).cast("int"))
    rows = views.table(spark, sf, "events").select(
        "event_id", piece.alias("piece"), F.concat("event_type", piece, "props").alias("longer")
    )
    path = staging_path(spark, "export")
    tables.export_csv(rows, path)
    return tables.read_delimited(spark, path, rows.schema, ",")


def _loaded(spark: SparkSession, name: str, rows: DataFrame) -> jobs.TableFolder:
    """A table that the command loads from a pipe-delimited file."""
    export, folder = staging_path(spark, "export"), staging_path(spark, "tables")
    tables.export_csv(rows, export, "|")
    jobs.run(spark, jobs._arguments(["load", name, "--source", export, "--tables", folder]))
    return jobs.TableFolder(spark, folder)


def _stored_service_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Trips by service hours, with the hours read from a stored table."""
    stored = _loaded(spark, "service_hours", views.service_hours(spark, sf)).service_hours()
    return service_hours.trips_by_service_hours(views.trips(spark, sf), stored, FIRST)


def _stored_bike_locations(spark: SparkSession, sf: str) -> DataFrame:
    """Vehicle kinds by day, with the locations read from a stored table."""
    stored = _loaded(spark, "bike_locations", views.bike_locations(spark, sf)).bike_locations()
    return vehicles.daily_vehicle_kinds(stored, PROVIDER, BIKES_BEFORE)


def _replace_year_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """The second system stored by year; one run more must not add rows."""
    trips = views.long_trips(spark, sf).withColumn("file_year", F.year("start_date"))
    table = staging_path(spark, "years-table")
    for _ in range(2):
        tables.replace_partitions(trips, table, TRIPS, "file_year")
    stored = spark.read.parquet(table)
    return stored.groupBy("file_year").agg(F.count("*").alias("trips"))


def _station_key_check(spark: SparkSession, sf: str) -> DataFrame:
    return key_violations(views.trips(spark, sf), ["bike_number", "start_station"])


# Results in their own types.
TYPED: dict[str, Query] = {
    **{name: _reported(report) for name, report in REPORTS.items()},
    "ingest_station_number_layout": _ingest_station_number_layout,
    "ingest_station_id_layout": _ingest_station_id_layout,
    "append_trips": _append_trips,
    "append_trips_again": _append_trips_again,
    "ingest_trips_by_year": _ingest_trips_by_year,
    "last_trip_id": _last_trip_id,
    "replace_year_partitions": _replace_year_partitions,
    "upsert_stations": _upsert_stations,
    "ingest_regions": _ingest_regions,
    "ingest_weather": _ingest_weather,
    "build_ebike_table": _build_ebike_table,
    "bulk_copy": _bulk_copy,
    "export_texts": _export_texts,
    "stored_service_hours": _stored_service_hours,
    "stored_bike_locations": _stored_bike_locations,
    "key_violations": _station_key_check,
    "appended_key_violations": _appended_key_check,
    "append_checked_trips": _append_checked_trips,
    "rejected_trips": _rejected_trips,
    "stored_last_trip_id": _stored_last_trip_id,
    **{f"kept_{name}": _reported_kept(REPORTS[name]) for name in KEPT},
}

# Decimals kept of fractional results, which both engines add up in their own order.
DIGITS = 6
# Of densities, which Spark adds up from bins and the SQL from every value.
DENSITY_DIGITS = 4


def comparable(df: DataFrame) -> DataFrame:
    """Dates and timestamps as text, fractions rounded: the form in which two engines agree."""

    def plain(f: T.StructField):
        c = F.col(f.name)
        if isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c, DENSITY_DIGITS if f.name == "density" else DIGITS)
        return c.alias(f.name)

    return df.select(*[plain(f) for f in df.schema])


def queries() -> dict[str, Query]:
    return {
        name: (lambda spark, sf, run=run: comparable(run(spark, sf)))
        for name, run in TYPED.items()
    }
