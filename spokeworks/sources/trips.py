"""Trip CSV drops."""

from __future__ import annotations

import csv
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spokeworks.operators.rowids import BLOCK, FILE, SEQUENCE, with_file_position
from spokeworks.schemas import STATION_NUMBER_LAYOUT, TRIPS, TripLayout
from spokeworks.sources import files


def parse_timestamp(text: Column) -> Column:
    """ISO text or ``month/day/year hour:minute[:second]``; other text is an error."""
    slashed = text.rlike(r"^\s*\d{1,2}/\d{1,2}/\d{4}\s")
    return F.when(
        slashed, F.to_timestamp_ntz(F.trim(text), F.lit("M/d/yyyy H:mm[:ss]"))
    ).otherwise(text.cast("timestamp_ntz"))


def scan_trip_files(spark: SparkSession, path: str, year: int | None = None) -> DataFrame:
    """Text columns of all CSVs in ``path``, or of those with ``year`` in their name or in
    the name of their sub-folder.

    The first file's header names the columns. A file with another header, and a row
    with fewer or more fields than the header, are errors, not a silent shift of columns.
    """
    return scan_csv(spark, [f"{path.rstrip('/')}/*{year}*" if year is not None else path])


_OPTIONS = {"header": True, "escape": '"', "pathGlobFilter": "*.csv"}
# whole rows are parsed, also for a few columns: else their length isn't seen
_WHOLE = {"enforceSchema": False, "columnPruning": False}


def scan_csv(spark: SparkSession, paths: list[str], header_of: str | None = None) -> DataFrame:
    """Text columns of trip CSVs, named by the header of ``header_of`` or of any of them."""
    header = _header(spark, paths, header_of)
    return spark.read.schema(header).options(**_OPTIONS, **_WHOLE, mode="FAILFAST").csv(paths)


def _header(spark: SparkSession, paths: list[str], header_of: str | None) -> T.StructType:
    """Text columns by the first line of a file, which is read without a Spark job if it is known."""
    if header_of is not None:
        line = files.first_line(spark, header_of) or ""
        names = next(csv.reader([line.removeprefix("\ufeff")]), [])
        if all(names) and len({n.lower() for n in names}) == len(names) > 0:
            return T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.options(**_OPTIONS).csv(header_of or paths).schema


REASON, RECORD = "_reason", "_record"


def scan_checked(spark: SparkSession, path: str, layout: TripLayout) -> DataFrame:
    """Typed trips of a folder with ``_file``, ``_block``, the raw ``_record`` of a row of another
    length than the header, and ``_reason``: why a row can't be a trip, or NULL.

    Nothing is refused here; the values of a row with a reason are not to be used.
    """
    first = files.files_below(spark, path, ".csv")
    header = _header(spark, [path], first[0][0] if first else None)
    with_record = T.StructType([*header.fields, T.StructField(RECORD, T.StringType())])
    scan = (
        spark.read.schema(with_record)
        .options(**_OPTIONS, **_WHOLE, mode="PERMISSIVE", columnNameOfCorruptRecord=RECORD)
        .csv(path)
        .select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK))
    )
    columns = layout.columns(header.names)
    typed, reasons = [], [F.when(F.col(RECORD).isNotNull(), "fields")]
    for f in TRIPS:
        text = F.col(f"`{columns[f.name]}`")
        value = try_timestamp(text) if isinstance(f.dataType, T.DatetimeType) else text.try_cast(f.dataType)
        typed.append(value.alias(f.name))
        reasons.append(F.when(text.isNotNull() & value.isNull(), f.name))
    whole = F.concat_ws(",", *(F.coalesce(F.col(f"`{n}`"), F.lit("")) for n in header.names))
    record = F.coalesce(RECORD, whole)
    return scan.select(*typed, FILE, BLOCK, record.alias(RECORD), F.coalesce(*reasons).alias(REASON))


def try_timestamp(text: Column) -> Column:
    """``parse_timestamp``, but NULL for text that is no timestamp.

    A slashed date is put in the ISO form first: so no session time zone takes part.
    """
    pattern = r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*$"
    part = [F.regexp_extract(text, pattern, i) for i in range(1, 7)]
    day = F.concat_ws("-", part[2], F.lpad(part[0], 2, "0"), F.lpad(part[1], 2, "0"))
    second = F.when(part[5] == "", "00").otherwise(part[5])
    iso = F.concat(day, F.lit(" "), F.lpad(part[3], 2, "0"), F.lit(":"), part[4], F.lit(":"), second)
    return F.when(text.rlike(pattern), iso).otherwise(text).try_cast("timestamp_ntz")


def position_good(checked: DataFrame) -> DataFrame:
    """The rows of ``scan_checked`` that are trips, with their place among these (see ``number_rows``)."""
    good = checked.where(F.col(REASON).isNull())
    return good.select(*TRIPS.names, FILE, BLOCK, F.monotonically_increasing_id().alias(SEQUENCE))


def to_trips(scan: DataFrame, columns: dict[str, str], *extra: str) -> DataFrame:
    """Typed trip columns; ``columns`` maps them to text columns. ``extra`` is passed on."""

    def typed(name: str) -> Column:
        text = F.col(f"`{columns[name]}`")
        kind = TRIPS[name].dataType
        value = parse_timestamp(text) if name in ("start_date", "end_date") else text.cast(kind)
        return value.alias(name)

    return scan.select(*[typed(f.name) for f in TRIPS], *extra)


def read_trips(
    spark: SparkSession,
    path: str,
    layout: TripLayout = STATION_NUMBER_LAYOUT,
    year: int | None = None,
) -> DataFrame:
    scan = scan_trip_files(spark, path, year)
    return to_trips(scan, layout.columns(scan.columns))


def read_positioned_trips(
    spark: SparkSession, path: str, layout: TripLayout = STATION_NUMBER_LAYOUT
) -> DataFrame:
    """``read_trips`` with each row's place in the files (see ``number_rows``)."""
    scan = scan_trip_files(spark, path)
    placed = with_file_position(scan)
    return to_trips(placed, layout.columns(scan.columns), FILE, BLOCK, SEQUENCE)


def year_of(file: Column, path: str, years: list[int]) -> Column:
    """The first of ``years`` that the part of a file's path right below ``path`` holds.

    That is a file's own name, or the name of its sub-folder.
    """
    root = path.rstrip("/").rpartition("/")[2]
    plain = F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B")))
    below = F.regexp_extract(plain, f"/{re.escape(root)}/([^/]+)", 1)
    return F.coalesce(*(F.when(below.contains(str(y)), F.lit(y)) for y in years))


class YearFiles(NamedTuple):
    first: str  # by name
    size: int  # bytes of all
    shared: bool  # whether the name of some file holds another of the years as well


def files_of_years(spark: SparkSession, path: str, years: list[int]) -> dict[int, YearFiles]:
    """The files of each year that has any; from one listing.

    As in ``year_of``, a year is looked for in the part of the path right below ``path``.
    """
    listed = files.files_below(spark, path, ".csv")
    root = path.rstrip("/").rpartition("/")[2]
    found: dict[int, YearFiles] = {}
    shared: set[int] = set()
    for file, size in listed:
        below = re.search(f"/{re.escape(root)}/([^/]+)", file)
        held = [y for y in years if below and str(y) in below[1]]
        if held:
            first, before, _ = found.get(held[0], (file, 0, False))
            found[held[0]] = YearFiles(first, before + size, False)
            shared.update(held if len(held) > 1 else ())
    return {y: own._replace(shared=y in shared) for y, own in found.items()}
