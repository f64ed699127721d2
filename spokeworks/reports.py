"""All analyses by name, over a set of tables and the dates of a study."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from spokeworks.plans import (
    distance,
    durations,
    fleet,
    history,
    service_hours,
    shares,
    stations,
    utilisation,
    vehicles,
)
from spokeworks.plans.history import History
from spokeworks.plans.vehicle_history import VehicleHistory


class Tables(Protocol):
    """What the analyses read. Only the tables a report names are opened.

    The histories and ``second_lives`` are kept aggregates of ``trips``, ``bike_locations`` and
    ``second_trips``; None if there are none, or not of all rows. A report then reads the table itself.
    """

    spark: SparkSession

    def trips(self) -> DataFrame: ...
    def stations(self) -> DataFrame: ...
    def weather(self) -> DataFrame: ...
    def service_hours(self) -> DataFrame: ...
    def bike_locations(self) -> DataFrame: ...
    def second_trips(self) -> DataFrame: ...
    def ebikes(self) -> DataFrame: ...
    def history(self) -> History | None: ...
    def second_lives(self) -> DataFrame | None: ...
    def vehicle_history(self, bikes_before: dt.date) -> VehicleHistory | None: ...


@dataclass(frozen=True)
class Study:
    """Dates, provider and events of a study.

    Fixed values: the defaults are the dates and events of the electric-bike pilot
    and of the dockless vehicles of 2018.
    """

    first: dt.date = dt.date(2018, 9, 5)
    last: dt.date = dt.date(2018, 10, 31)
    fleet_first: dt.date = dt.date(2018, 9, 1)
    fleet_last: dt.date = dt.date(2018, 9, 30)
    second_first: dt.date = dt.date(2018, 8, 20)
    second_last: dt.date = dt.date(2018, 9, 30)
    ebike_first: dt.date = dt.date(2018, 8, 20)
    ebike_last: dt.date = dt.date(2018, 8, 25)
    provider: str | None = None
    bikes_before: dt.date = dt.date(2018, 3, 10)
    seen_by: dt.datetime = dt.datetime(2018, 9, 14)
    events: tuple[tuple[dt.date, str, str], ...] = (
        (dt.date(2018, 3, 10), "scooters", "Scooters Intro  "),
        (dt.date(2018, 4, 27), "scooters", "DDOT extends pilot to Aug  "),
        (dt.date(2018, 5, 21), "scooters", "More scooters announced  "),
        (dt.date(2018, 8, 30), "scooters", "DDOT extends pilot to Dec  "),
    )


Report = Callable[[Tables, Study], DataFrame]


def _utilisation(t: Tables, s: Study) -> DataFrame:
    return utilisation.daily_utilisation(t.trips(), t.weather(), s.first, s.last, kept=t.history())


def _shares(t: Tables, s: Study) -> DataFrame:
    return shares.daily_share_of_total(t.trips(), s.first)


def _fleet_shares(t: Tables, s: Study) -> DataFrame:
    return shares.fleet_vs_trip_share(t.trips(), s.first, s.last, kept=t.history())


def _measured(t: Tables, s: Study, keep: tuple[str, ...] = ()) -> DataFrame:
    return distance.trip_distance_speed(t.trips(), t.stations(), s.first, keep=keep)


def _hours(t: Tables, s: Study) -> DataFrame:
    return service_hours.trips_by_service_hours(t.trips(), t.service_hours(), s.first)


def _kinds(t: Tables, s: Study) -> DataFrame:
    if (kept := t.vehicle_history(s.bikes_before)) is not None:
        return kept.daily_kinds(s.provider)
    return vehicles.daily_vehicle_kinds(t.bike_locations(), s.provider, s.bikes_before)


def _monthly(t: Tables, s: Study) -> DataFrame:
    if (kept := t.history()) is not None:
        return history.monthly_basic_stats(kept, s.first)
    return durations.monthly_basic_stats(t.trips(), s.first)


def _total_scooters(t: Tables, s: Study) -> DataFrame:
    if (kept := t.vehicle_history(s.bikes_before)) is not None:
        return kept.total_scooters()
    return vehicles.total_scooters(t.bike_locations())


def _total_vehicles(t: Tables, s: Study) -> DataFrame:
    if (kept := t.vehicle_history(s.bikes_before)) is not None:
        return kept.total_vehicles(s.provider)
    return vehicles.total_vehicles(t.bike_locations(), s.provider)


def _vehicle_age(t: Tables, s: Study) -> DataFrame:
    if (kept := t.vehicle_history(s.bikes_before)) is not None:
        return kept.avg_vehicle_age(s.provider, s.seen_by)
    return vehicles.avg_vehicle_age(t.bike_locations(), s.provider, s.seen_by)


def _apportioned(t: Tables, s: Study) -> DataFrame:
    return vehicles.vehicle_kinds_apportioned(_kinds(t, s))


REPORTS: dict[str, Report] = {
    "avg_duration_by_date": lambda t, s: durations.avg_duration_by_date(t.trips(), s.first),
    "avg_duration_by_dow": lambda t, s: durations.avg_duration_by_dow(t.trips(), s.first),
    "avg_duration_by_date_members": lambda t, s: durations.avg_duration_by_date(
        t.trips(), s.first, "Member"
    ),
    "monthly_basic_stats": _monthly,
    "casual_trips_by_station": lambda t, s: stations.trips_by_station(
        t.trips(), t.stations(), s.first, "Casual"
    ),
    "member_trips_by_station": lambda t, s: stations.trips_by_station(
        t.trips(), t.stations(), s.first, "Member"
    ),
    "same_station_share": lambda t, s: durations.same_station_share(t.trips(), s.first),
    "same_station_duration_stats": lambda t, s: durations.same_station_duration_stats(
        t.trips(), s.first
    ),
    "same_station_duration_hist": lambda t, s: durations.same_station_duration_hist(
        t.trips(), s.first
    ),
    "same_station_duration_cdf": lambda t, s: durations.same_station_duration_cdf(
        t.trips(), s.first
    ),
    "daily_fleet_calendar": lambda t, s: fleet.daily_fleet_calendar(
        t.trips(), s.fleet_first, s.fleet_last, kept=t.history()
    ),
    "daily_fleet_trip_days": lambda t, s: fleet.daily_fleet_trip_days(
        t.trips(), s.first, kept=t.history()
    ),
    "ebike_fleet_calendar": lambda t, s: fleet.ebike_fleet_calendar(
        t.second_trips(), t.ebikes(), s.second_first, s.second_last, lives=t.second_lives()
    ),
    "first_seen_in_window": lambda t, s: fleet.first_seen_in_window(
        t.second_trips(), s.ebike_first, s.ebike_last, t.second_lives()
    ),
    "daily_utilisation": _utilisation,
    "trips_per_fleet_bike_long": lambda t, s: utilisation.trips_per_fleet_bike_long(
        _utilisation(t, s)
    ),
    "trips_per_used_bike_long": lambda t, s: utilisation.trips_per_used_bike_long(
        _utilisation(t, s)
    ),
    "overall_trips_per_bike": lambda t, s: utilisation.overall_trips_per_bike(_utilisation(t, s)),
    "daily_share_of_total": _shares,
    "daily_share_long": lambda t, s: shares.daily_share_long(_shares(t, s)),
    "fleet_vs_trip_share": _fleet_shares,
    "fleet_vs_trip_share_long": lambda t, s: shares.fleet_vs_trip_share_long(_fleet_shares(t, s)),
    "trip_distance_speed": lambda t, s: _measured(t, s, keep=("trip_id",)),
    "avg_distance_speed_by_type": lambda t, s: distance.avg_distance_speed_by_type(
        _measured(t, s)
    ),
    "daily_distance_speed": lambda t, s: distance.daily_distance_speed(_measured(t, s)),
    "density_curves": lambda t, s: distance.density_curves(_measured(t, s)),
    "distance_density": lambda t, s: distance.distance_density(
        distance.pair_distances(t.trips(), t.stations(), s.first)
    ),
    "top_routes": lambda t, s: stations.top_routes(t.trips(), t.stations(), s.first),
    "trips_by_service_hours": _hours,
    "service_hours_share": lambda t, s: service_hours.service_hours_share(_hours(t, s)),
    "daily_vehicle_kinds": _kinds,
    "vehicle_kinds_apportioned": _apportioned,
    "vehicle_kinds_long_events": lambda t, s: vehicles.vehicle_kinds_long_events(
        _apportioned(t, s), s.events
    ),
    "total_scooters": _total_scooters,
    "total_vehicles": _total_vehicles,
    "avg_vehicle_age": _vehicle_age,
    "first_trip_per_bike": lambda t, s: durations.first_trip_per_bike(t.trips()),
}
