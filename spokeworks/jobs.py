"""Command line: ``spark-submit spokeworks/jobs.py`` or ``python -m spokeworks.jobs``.

    append-trips  --source DIR --tables DIR [--most-bad SHARE] [--resume]
    locations     --source DIR --tables DIR [--bikes-before DATE] [--sep "|"]
    history       --tables DIR [--compact]
    trips-by-year --source DIR --tables DIR --years 2013 2014 [--missing-ok]
    stations      --source DIR --tables DIR
    regions       --source DIR --tables DIR
    weather       --source DIR --tables DIR [--first DATE --last DATE]
    ebikes        --tables DIR [--first DATE --last DATE]
    load TABLE    --source FILE --tables DIR [--sep "|"]
    report NAME   --tables DIR --out DIR [--provider NAME]
                  [--first DATE --last DATE] [--sep ,]

A bound that a job does not use is an error.
"""

from __future__ import annotations

import argparse
import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

from spokeworks import schemas
from spokeworks.plans import history, ingest
from spokeworks.plans.history import History
from spokeworks.plans.vehicle_history import VehicleHistory
from spokeworks.reports import REPORTS, Study
from spokeworks.session import session
from spokeworks.sources import drops, files
from spokeworks.sources.tables import export_csv, read_table, read_trips_table


@dataclass(frozen=True)
class TableFolder:
    """Tables stored as Parquet in the sub-folders of one folder."""

    spark: SparkSession
    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def trips(self) -> DataFrame:
        return read_trips_table(self.spark, self.path("trips"))

    def stations(self) -> DataFrame:
        return read_table(self.spark, self.path("stations"), schemas.STATIONS)

    def weather(self) -> DataFrame:
        return read_table(self.spark, self.path("weather"), schemas.WEATHER)

    def service_hours(self) -> DataFrame:
        return read_table(self.spark, self.path("service_hours"), schemas.SERVICE_HOURS)

    def bike_locations(self) -> DataFrame:
        return read_table(self.spark, self.path("bike_locations"), schemas.DEVICE_LOCATIONS)

    def second_trips(self) -> DataFrame:
        return read_table(self.spark, self.path("second_trips"), schemas.TRIPS)

    def ebikes(self) -> DataFrame:
        return read_table(self.spark, self.path("ebikes"), schemas.EBIKES)

    def history(self) -> History | None:
        return history.read_history(self.spark, self.path("trips"))

    def second_lives(self) -> DataFrame | None:
        return history.read_year_lives(self.spark, self.path("second_trips"))

    def vehicle_history(self, bikes_before: dt.date) -> VehicleHistory | None:
        """Only of a table whose drops it has all; one that was filled otherwise is read itself."""
        kept = ingest.vehicle_history(self.spark, self.path("bike_locations"), bikes_before)
        stored = files.folder_names(self.spark, self.path("bike_locations"))
        drops = {n.partition("=")[2] for n in stored if n.startswith("drop=")}
        return kept if drops and drops == set(kept.batches()) else None


# Reports over vehicles of one provider.
_OF_PROVIDER = {
    "daily_vehicle_kinds",
    "vehicle_kinds_apportioned",
    "vehicle_kinds_long_events",
    "total_vehicles",
    "avg_vehicle_age",
}


# Where a report's own period has a name of its own in the study.
_PERIOD = {
    "daily_fleet_calendar": "fleet_",
    "ebike_fleet_calendar": "second_",
    "first_seen_in_window": "ebike_",
}

# Reports over a closed period; the others with a first day are open to the end.
CLOSED = set(_PERIOD) | {
    "daily_utilisation",
    "trips_per_fleet_bike_long",
    "trips_per_used_bike_long",
    "overall_trips_per_bike",
    "fleet_vs_trip_share",
    "fleet_vs_trip_share_long",
}

# Reports over all that there is.
UNBOUNDED = _OF_PROVIDER | {"total_scooters", "first_trip_per_bike"}

# Tables without a job of their own, which ``load`` fills from delimited files.
LOADED = {"service_hours": schemas.SERVICE_HOURS, "bike_locations": schemas.DEVICE_LOCATIONS}


def _study(name: str, args: argparse.Namespace) -> Study:
    """The default study, with the period of the report replaced if given."""
    prefix = _PERIOD.get(name, "")
    given = {
        f"{prefix}first": args.first,
        f"{prefix}last": args.last,
        "provider": args.provider,
        "bikes_before": args.bikes_before,
        "seen_by": args.seen_by,
    }
    known = {f.name for f in fields(Study)}
    return replace(Study(), **{k: v for k, v in given.items() if v is not None and k in known})


def _arguments(argv: Sequence[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    jobs = parser.add_subparsers(dest="job", required=True)
    date = dt.date.fromisoformat

    def job(name: str, *, source: bool = True, period: bool = False) -> argparse.ArgumentParser:
        sub = jobs.add_parser(name)
        sub.add_argument("--tables", required=True)
        if source:
            sub.add_argument("--source", required=True)
        if period:
            sub.add_argument("--first", type=date)
            sub.add_argument("--last", type=date)
        return sub

    append = job("append-trips")
    append.add_argument("--most-bad", type=float)
    append.add_argument("--resume", action="store_true")
    for name in ("stations", "regions"):
        job(name)
    locations = job("locations")
    locations.add_argument("--bikes-before", type=date, default=Study.bikes_before)
    locations.add_argument("--sep", default="|")
    job("history", source=False).add_argument("--compact", action="store_true")
    job("weather", period=True)
    by_year = job("trips-by-year")
    by_year.add_argument("--years", type=int, nargs="+", required=True)
    by_year.add_argument("--missing-ok", action="store_true")
    job("ebikes", source=False, period=True)
    load = job("load")
    load.add_argument("name", choices=sorted(LOADED))
    load.add_argument("--sep", default="|")
    report = job("report", source=False, period=True)
    report.add_argument("name", choices=sorted(REPORTS))
    report.add_argument("--out", required=True)
    report.add_argument("--sep", default=",")
    report.add_argument("--provider")
    report.add_argument("--bikes-before", type=date)
    report.add_argument("--seen-by", type=dt.datetime.fromisoformat)
    args = parser.parse_args(argv)
    if args.job == "report" and args.name in _OF_PROVIDER and args.provider is None:
        parser.error(f"{args.name} needs --provider")
    if args.job == "report":
        if args.last is not None and args.name not in CLOSED:
            parser.error(f"{args.name} has no last day")
        if args.first is not None and args.name in UNBOUNDED:
            parser.error(f"{args.name} has no first day")
    return args


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    tables = TableFolder(spark, args.tables)
    match args.job:
        case "append-trips":
            ingest.append_trips(
                spark,
                args.source,
                tables.path("trips"),
                most_bad=args.most_bad,
                resume=args.resume,
            )
        case "locations":
            ingest.add_locations(
                spark, args.source, tables.path("bike_locations"), args.bikes_before, args.sep
            )
        case "history":
            with drops.claimed(spark, tables.path("trips")):
                history.advance(spark, tables.path("trips"))
                if args.compact:
                    history.compact(spark, tables.path("trips"))
        case "trips-by-year":
            ingest.ingest_trips_by_year(
                spark,
                args.source,
                tables.path("second_trips"),
                args.years,
                missing_ok=args.missing_ok,
            )
        case "stations":
            ingest.upsert_stations(spark, args.source, tables.path("stations"))
        case "regions":
            ingest.ingest_regions(spark, args.source, tables.path("regions"))
        case "weather":
            ingest.ingest_weather(
                spark, args.source, tables.path("weather"), args.first, args.last
            )
        case "ebikes":
            study = Study()
            ingest.build_ebike_table(
                tables.second_trips(),
                tables.path("ebikes"),
                args.first or study.ebike_first,
                args.last or study.ebike_last,
                tables.second_lives(),
            )
        case "load":
            ingest.load_delimited(
                spark, args.source, tables.path(args.name), LOADED[args.name], args.sep
            )
        case "report":
            export_csv(REPORTS[args.name](tables, _study(args.name, args)), args.out, args.sep)


def main(argv: Sequence[str] | None = None) -> None:
    args = _arguments(argv)
    run(session(f"spokeworks {args.job}"), args)


if __name__ == "__main__":
    main()
