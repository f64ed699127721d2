"""Ingest jobs: from raw drops and snapshots to stored tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from spokeworks.operators.conform import require_new_keys
from spokeworks.operators.rowids import FILE, number_rows
from spokeworks.operators.staging import passing_copies, stage
from spokeworks.plans import history
from spokeworks.plans.fleet import first_seen_in_window
from spokeworks.plans.vehicle_history import VehicleHistory
from spokeworks.schemas import (
    DEVICE_LOCATIONS,
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
from spokeworks.sources import drops
from spokeworks.sources.snapshots import (
    read_region_snapshot,
    read_station_snapshot,
    read_weather,
    region_codes,
)
from spokeworks.sources.tables import (
    append_table,
    append_trips_table,
    export_csv,
    load_delimited,
    read_delimited,
    read_table,
    replace_partitions,
    replace_table,
    stored_last_id,
)
from spokeworks.sources.trips import (
    REASON,
    RECORD,
    files_of_years,
    position_good,
    read_positioned_trips,
    scan_checked,
    scan_csv,
    to_trips,
    year_of,
)

#: Bytes of a year's trip files that one task reads and stores.
YEAR_BYTES = 64 << 20


def numbered_trips(
    spark: SparkSession, path: str, last: int, layout: TripLayout = STATION_NUMBER_LAYOUT
) -> DataFrame:
    """Trips of a folder of CSVs with ``trip_id`` counting on from ``last``, in the
    order of file names and rows."""
    placed = stage(read_positioned_trips(spark, path, layout), "trips")
    return number_rows(placed, last, "trip_id")


def checked_trips(
    spark: SparkSession, path: str, last: int, layout: TripLayout, most_bad: float, rejected: str
) -> DataFrame:
    """``numbered_trips`` without the rows that can't be trips, which go to the folder ``rejected``.

    Those are rows with more or fewer fields than the header, and rows with a value that
    doesn't fit its type. They are written as ``file, record, reason``, where the reason
    is ``fields`` or the column. If their share is above ``most_bad``, that is an error, and
    nothing is kept but them. They are counted while the good rows are staged, so files without
    bad rows, as most are, are parsed once.
    """
    checked = scan_checked(spark, path, layout)
    seen = Observation()
    bad = F.col(REASON).isNotNull()
    placed = stage(position_good(checked.observe(seen, F.count("*").alias("n"), F.count_if(bad).alias("bad"))), "trips")
    n, n_bad = seen.get["n"], seen.get["bad"]
    if n_bad:
        rows = checked.where(bad).select(
            F.url_decode(F.replace(FILE, F.lit("+"), F.lit("%2B"))).alias("file"),
            F.col(RECORD).alias("record"),
            F.col(REASON).alias("reason"),
        )
        rows.write.mode("overwrite").parquet(rejected)
    if n_bad > most_bad * n:
        raise ValueError(f"{n_bad} of {n} rows of {path} can't be trips; they are in {rejected}")
    return number_rows(placed, last, "trip_id")


def append_trips(
    spark: SparkSession,
    path: str,
    table: str,
    layout: TripLayout = STATION_NUMBER_LAYOUT,
    most_bad: float | None = None,
    keep: bool = True,
    resume: bool = False,
) -> None:
    """Add a folder of trip CSVs to a table; ids continue from the largest stored one.

    A drop that the table has is not added again, so a failed job may be run again; two
    jobs can't add at once: see ``drops``. The staged copy of the drop is removed once the
    table has it. A row that can't be a trip is an error, or, up to a share of ``most_bad``,
    it is put into ``<table>_rejected``. The history of the table is advanced as well,
    unless ``keep`` is false.
    """
    with drops.claimed(spark, table, resume):
        last = stored_last_id(spark, table, NUMBERED_TRIPS, "trip_id")
        drop = drops.listed(spark, path)
        state, last = drops.begin(spark, table, drop, last)
        if state == drops.NEW:
            with passing_copies(spark):
                if most_bad is None:
                    new = numbered_trips(spark, path, last, layout)
                else:
                    new = checked_trips(spark, path, last, layout, most_bad, rejected_path(table, drop.id))
                append_trips_table(new, table)
        if state != drops.FINISHED:
            drops.finish(spark, table, drop)
        if keep:
            history.advance(spark, table)


def rejected_path(table: str, drop_id: str = "") -> str:
    """The folder of the rows that were refused, of one drop or of all."""
    folder = f"{table.rstrip('/')}_rejected"
    return f"{folder}/drop={drop_id}" if drop_id else folder


def add_locations(
    spark: SparkSession, path: str, table: str, bikes_before: dt.date, sep: str = "|"
) -> None:
    """Add delimited files of device locations to a table stored by drop, and to its vehicle history.

    A drop is a folder of its own, written as a whole: run again it replaces itself. Then its
    vehicles are counted, once.
    """
    with drops.claimed(spark, table):
        drop = drops.listed(spark, path)
        state, _ = drops.begin(spark, table, drop, 0)
        own = f"{table.rstrip('/')}/drop={drop.id}"
        if state != drops.FINISHED:
            rows = read_delimited(spark, path, DEVICE_LOCATIONS, sep)
            rows.write.mode("overwrite").parquet(own)
        stored = spark.read.schema(DEVICE_LOCATIONS).parquet(own)
        vehicle_history(spark, table, bikes_before).add(stored, drop.id)
        if state != drops.FINISHED:
            drops.finish(spark, table, drop)


def vehicle_history(spark: SparkSession, table: str, bikes_before: dt.date) -> VehicleHistory:
    return VehicleHistory(spark, f"{table.rstrip('/')}_history", bikes_before)


def ingest_trips_by_year(
    spark: SparkSession,
    path: str,
    table: str,
    years: Iterable[int],
    layout: TripLayout = STATION_ID_LAYOUT,
    missing_ok: bool = False,
) -> None:
    """Store the CSVs whose name (or folder) holds one of ``years``, one partition per year.

    The folder is listed once, and all years are written by one job and published at
    once. A year is a scan of its own and is written by as many tasks as its files have pieces of
    ``YEAR_BYTES``, so its rows are never shuffled. A rerun replaces the
    years it covers. A year without files is an error, unless ``missing_ok``.
    """
    years = sorted(set(years))
    found = files_of_years(spark, path, years)
    absent = [y for y in years if y not in found]
    if absent and not missing_ok:
        raise ValueError(f"no files of the years {absent} in {path}")
    parts = []
    for year, own in found.items():
        scan = scan_csv(spark, [f"{path.rstrip('/')}/*{year}*"], own.first)
        dated = scan.withColumn("file_year", F.lit(year))
        if own.shared:  # a file is of the first year that its name holds
            dated = dated.where(year_of(F.col("_metadata.file_path"), path, years) == year)
        typed = to_trips(dated, layout.columns(scan.columns), "file_year")
        # not into one: of years of one piece each, a union would make one task
        parts.append(typed.coalesce(max(2, -(-own.size // YEAR_BYTES))))
    if parts:
        # what is kept of a year goes before the year does: nothing kept is ever of other trips
        with drops.claimed(spark, f"{table.rstrip('/')}_history"):
            history.forget_years(spark, table, sorted(found))
            replace_partitions(reduce(DataFrame.unionByName, parts), table, TRIPS, "file_year", apart=True)
            history.keep_years(spark, table, sorted(found))


def merge_stations(snapshot: DataFrame, stored: DataFrame) -> DataFrame:
    """One station per ``short_name``: the first of the snapshot, else the stored one
    with the lowest id. Stations without a short name count as one.

    The winner is picked by an aggregate, which combines before the shuffle and
    needs no group in memory.
    """
    new = snapshot.withColumn("_stored", F.lit(False))
    old = stored.withColumns({"_stored": F.lit(True), "position": F.lit(None).cast("int")})
    row = F.struct(*[F.col(f.name) for f in STATIONS])
    return (
        new.unionByName(old)
        .groupBy(F.col("short_name").alias("_key"))
        .agg(F.min_by(row, F.struct("_stored", "position", "station_id")).alias("station"))
        .select("station.*")
    )


def upsert_stations(spark: SparkSession, snapshot_path: str, table: str) -> None:
    """Replace the station table by the snapshot and the stored stations it lacks."""
    stored = read_table(spark, table, STATIONS)
    merged = merge_stations(read_station_snapshot(spark, snapshot_path), stored)
    replace_table(merged, table, STATIONS, key=["station_id"])


def coded_regions(spark: SparkSession, snapshot_path: str) -> DataFrame:
    """``region_id, name, code``; the code list is a literal of a few rows."""
    codes = F.broadcast(region_codes(spark))
    regions = read_region_snapshot(spark, snapshot_path)
    return regions.join(codes, "name", "left").select("region_id", "name", "code")


def ingest_regions(spark: SparkSession, snapshot_path: str, table: str) -> None:
    replace_table(coded_regions(spark, snapshot_path), table, REGIONS, key=["region_id"])


def ingest_weather(
    spark: SparkSession,
    path: str,
    table: str,
    first: dt.date | None = None,
    last: dt.date | None = None,
) -> None:
    """Add daily weather; a date that is stored already or comes twice is an error."""
    with drops.claimed(spark, table), passing_copies(spark):
        days = stage(read_weather(spark, path, first, last), "weather")
        stored = read_table(spark, table, WEATHER).select("weather_date")
        require_new_keys(days, stored, ["weather_date"])
        append_table(days, table, WEATHER)


def build_ebike_table(
    trips: DataFrame, table: str, first: dt.date, last: dt.date, lives: DataFrame | None = None
) -> None:
    """Store the bikes whose first trip lies in ``first..last``."""
    replace_table(first_seen_in_window(trips, first, last, lives), table, EBIKES)


def bulk_copy(df: DataFrame, export: str, table: str) -> None:
    """Export as pipe-delimited text, then load the export into a table."""
    export_csv(df, export, "|")
    load_delimited(df.sparkSession, export, table, df.schema)
