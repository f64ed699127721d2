from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest
from helpers import DAY, at, by, dicts, hours, locations, plan, stations, trip, trips
from pyspark.sql import functions as F

from spokeworks.plans import (
    distance,
    durations,
    fleet,
    service_hours,
    shares,
    utilisation,
    vehicles,
)
from spokeworks.plans import stations as ranking
from spokeworks.schemas import DEVICE_LOCATIONS

D = dt.date


def test_avg_duration_leaves_out_backward_and_early_trips(spark):
    df = trips(
        spark,
        trip("2018-09-10 08:00:00", "2018-09-10 08:10:00"),
        trip("2018-09-10 09:00:00", "2018-09-10 09:20:00", member="Casual"),
        trip("2018-09-10 09:00:00", "2018-09-10 09:00:00"),
        trip("2018-09-10 09:00:00", "2018-09-10 08:00:00"),
        trip("2018-09-10 09:00:00", "2018-09-10 09:30:00", bike=None),
        trip("2018-09-04 23:59:59", "2018-09-05 05:00:00"),
        trip("2018-09-05 00:00:00", "2018-09-05 00:05:00"),
    )
    got = by(durations.avg_duration_by_date(df, D(2018, 9, 5)), "date", "bike_type")
    assert {k: r["avg_seconds"] for k, r in got.items()} == {
        (D(2018, 9, 10), "Classic"): 900.0,
        (D(2018, 9, 10), "Plus"): 1800.0,
        (D(2018, 9, 5), "Classic"): 300.0,
    }
    members = by(durations.avg_duration_by_date(df, D(2018, 9, 5), "Member"), "date", "bike_type")
    assert members[D(2018, 9, 10), "Classic"]["avg_seconds"] == 600.0
    dow = by(durations.avg_duration_by_dow(df, D(2018, 9, 5)), "dow", "bike_type")
    assert set(dow) == {(1, "Classic"), (1, "Plus"), (3, "Classic")}


def test_monthly_stats_merge_years_unless_asked(spark):
    df = trips(
        spark,
        trip("2018-09-10 08:00:00", bike="W1"),
        trip("2018-09-11 08:00:00", bike="W1", member="Casual"),
        trip("2019-09-11 08:00:00", bike="W2", member="Other"),
        trip("2018-09-11 08:00:00", bike=None),
    )
    got = by(durations.monthly_basic_stats(df, D(2018, 9, 5)), "month", "bike_type")
    classic = got[9, "Classic"]
    assert (classic["trips"], classic["bikes"]) == (3, 2)
    assert classic["member_share"] == pytest.approx(1 / 3)
    assert (classic["casual_trips"], classic["member_trips"]) == (1, 1)
    assert (got[9, "Plus"]["trips"], got[9, "Plus"]["bikes"]) == (1, 0)
    yearly = by(durations.monthly_basic_stats(df, D(2018, 9, 5), True), "year", "bike_type")
    assert yearly[2018, "Classic"]["trips"] == 2
    assert yearly[2019, "Classic"]["trips"] == 1


def test_same_station_limits(spark):
    same = {"start_station": "a", "end_station": "a"}
    df = trips(
        spark,
        trip(at("08:00:00"), at("08:59:59.999999"), **same),
        trip(at("08:00:00"), at("09:00:00"), **same),
        trip(at("08:00:00"), at("08:01:00"), **same),
        trip(at("08:00:00"), at("08:01:00"), **same),
        trip(at("08:00:00"), at("08:01:00")),
        trip(at("08:00:00"), at("08:01:00"), start_station=None, end_station=None),
        trip(at("08:00:00"), at("08:02:00"), member="Casual", **same),
    )
    first = D(2018, 9, 5)
    share = durations.same_station_share(df, first).first()
    assert share["same_station_share"] == pytest.approx(4 / 6)
    stats = durations.same_station_duration_stats(df, first).first()
    assert stats["min_seconds"] == 60.0
    assert stats["max_seconds"] == 3599.999999
    assert stats["avg_seconds"] == pytest.approx((120 + 3599.999999) / 3)
    hist = durations.same_station_duration_hist(df, first).collect()
    assert [(r["duration_us"], r["trips"]) for r in hist] == [(60_000_000, 2), (3_599_999_999, 1)]
    cdf = by(durations.same_station_duration_cdf(df, first), "minutes")
    assert cdf[1.0]["running_share"] == pytest.approx(2 / 3)
    assert max(r["running_share"] for r in cdf.values()) == 1.0


def test_first_trip_per_bike(spark):
    df = trips(spark, trip(at("09:00")), trip(at("08:00")), trip(at("07:00"), bike=None))
    assert dicts(durations.first_trip_per_bike(df)) == [
        {"bike_number": "W1", "first_start": at("08:00")}
    ]


def test_trips_by_station_keeps_unknown_stations(spark):
    df = trips(
        spark,
        trip(at("08:00"), start_station="a"),
        trip(at("09:00"), start_station="a"),
        trip(at("09:00"), start_station="x"),
        trip(at("09:00"), start_station=None),
        trip(at("09:00"), start_station="a", member="Casual"),
    )
    named = stations(spark, ("a", "Alpha", 38.9, -77.0), (None, "Nameless", 38.9, -77.0))
    got = ranking.trips_by_station(df, named, D(2018, 9, 5), "Member").collect()
    assert [(r["start_station"], r["start_name"], r["total_trips"]) for r in got] == [
        ("a", "Alpha", 2),
        ("x", None, 1),
        (None, None, 1),
    ]


def test_top_routes_breaks_ties_by_station(spark):
    rows = [trip(at("08:00"), start_station=s, end_station="z") for s in "abcdefghijkl"]
    rows += [trip(at("08:00"), start_station="l", end_station="z")]
    rows += [trip(at("08:00"), bike=None, start_station="n", end_station="z")] * 5
    rows += [trip(at("08:00"), bike="E1", start_station="a", end_station="q")]
    named = stations(spark, ("a", "Alpha", 38.9, -77.0), ("z", "Zulu", 38.9, -77.1))
    got = ranking.top_routes(trips(spark, *rows), named, D(2018, 9, 5)).collect()
    classic = [r for r in got if r["bike_type"] == "Classic"]
    assert [r["start_station"] for r in classic] == list("labcdefghi")
    assert classic[0]["total_trips"] == 2 and classic[0]["miles"] is None
    assert classic[1]["miles"] == pytest.approx(5.38, abs=0.01)
    assert [r["end_name"] for r in got if r["bike_type"] == "Plus"] == [None]


def test_fleet_counts_the_extra_day_and_keeps_days_without_trips(spark):
    df = trips(
        spark,
        trip("2018-08-20 08:00:00", bike="W1"),
        trip("2018-08-31 08:00:00", bike="W1"),
        trip("2018-09-02 08:00:00", bike="E1"),
        trip("2018-09-02 09:00:00", bike="E1"),
        trip("2018-09-02 09:00:00", bike=None),
        trip("2018-09-04 09:00:00", bike=None),
    )
    got = by(fleet.daily_fleet_calendar(df, D(2018, 9, 1), D(2018, 9, 4)), "date")
    assert [tuple(got[D(2018, 9, d)].values())[1:] for d in (1, 2, 3, 4)] == [
        (None, None, 1, 0),
        (0, 2, 0, 1),
        (None, None, 0, 1),
        (0, 0, 0, 1),
    ]
    days = fleet.daily_fleet_trip_days(df, D(2018, 9, 1)).collect()
    assert [r["date"] for r in days] == [D(2018, 9, 2), D(2018, 9, 4)]
    assert days[0]["plus_used"] == 1 and days[0]["classic_fleet"] == 0


def test_utilisation_ratios_survive_empty_fleets(spark):
    df = trips(
        spark,
        trip("2018-09-05 08:00:00", bike="W1"),
        trip("2018-09-05 09:00:00", bike="W1"),
        trip("2018-09-05 09:00:00", bike="W2"),
        trip("2018-09-07 09:00:00", bike="E1"),
    )
    rain = spark.createDataFrame(
        [(D(2018, 9, 5), 0.25), (D(2018, 12, 1), 0.5)], "weather_date DATE, precipprobability DOUBLE"
    )
    daily = utilisation.daily_utilisation(df, rain, D(2018, 9, 5), D(2018, 9, 7))
    rows = by(daily, "date")
    assert rows[D(2018, 9, 5)]["rain_probability"] == 0.25
    assert rows[D(2018, 9, 6)]["rain_probability"] is None
    by_fleet = by(utilisation.trips_per_fleet_bike_long(daily), "date", "bike_type")
    assert len(by_fleet) == 6
    assert by_fleet[D(2018, 9, 5), "Classic"]["trips_per_bike"] == 1.5
    assert by_fleet[D(2018, 9, 5), "Plus"]["trips_per_bike"] is None
    by_use = by(utilisation.trips_per_used_bike_long(daily), "date", "bike_type")
    assert by_use[D(2018, 9, 7), "Plus"]["trips_per_bike"] == 1.0
    overall = utilisation.overall_trips_per_bike(daily).first()
    assert overall["classic_trips_per_fleet_bike"] == pytest.approx(3 / 6)
    assert overall["classic_trips_per_used_bike"] == pytest.approx(3 / 2)
    assert overall["plus_trips_per_fleet_bike"] == 1.0


def test_calendar_may_start_before_the_trips_counted(spark):
    df = trips(spark, trip("2018-09-01 08:00:00"), trip("2018-09-05 08:00:00"))
    got = by(
        fleet.daily_fleet_calendar(df, D(2018, 9, 1), D(2018, 9, 5), from_day=D(2018, 9, 5)), "date"
    )
    assert got[D(2018, 9, 1)]["classic_trips"] is None
    assert got[D(2018, 9, 1)]["classic_fleet"] == 1
    assert got[D(2018, 9, 5)]["classic_trips"] == 1


def test_shares_of_total(spark):
    df = trips(
        spark,
        trip("2018-09-05 08:00:00", bike="W1"),
        trip("2018-09-06 08:00:00", bike="W1"),
        trip("2018-09-06 09:00:00", bike="W2"),
        trip("2018-09-06 09:00:00", bike=None),
        trip("2018-09-04 09:00:00", bike="W2"),
    )
    daily = shares.daily_share_of_total(df, D(2018, 9, 5))
    rows = by(daily, "date")
    assert rows[D(2018, 9, 6)]["classic_share"] == pytest.approx(2 / 3)
    assert rows[D(2018, 9, 6)]["total_classic_trips"] == 3
    assert rows[D(2018, 9, 5)]["plus_share"] is None
    long = by(shares.daily_share_long(daily), "date", "bike_type")
    assert long[D(2018, 9, 5), "Classic"]["share"] == pytest.approx(1 / 3)
    fleet_rows = shares.fleet_vs_trip_share(df, D(2018, 9, 5), D(2018, 9, 7))
    got = by(fleet_rows, "date")
    assert got[D(2018, 9, 6)]["total_trips"] == 3
    assert got[D(2018, 9, 6)]["plus_trip_share"] == 0.0
    assert got[D(2018, 9, 7)]["total_trips"] is None
    assert got[D(2018, 9, 7)]["total_fleet"] == 2
    pairs = by(shares.fleet_vs_trip_share_long(fleet_rows), "date", "stat_type")
    assert len(pairs) == 6
    assert pairs[D(2018, 9, 6), "% of Trips"]["trip_type"] == "Plus Trips"
    assert pairs[D(2018, 9, 6), "% of Fleet"]["daily_trips"] == 2


def test_ebike_calendar_uses_membership(spark):
    df = trips(
        spark,
        trip("2018-08-20 08:00:00", bike="1"),
        trip("2018-08-21 08:00:00", bike="2"),
        trip("2018-08-27 08:00:00", bike="3"),
        trip("2018-08-27 08:00:00", bike=None),
        trip("2018-08-01 08:00:00", bike="4"),
        trip("2018-08-27 08:00:00", bike="4"),
    )
    first, last = D(2018, 8, 20), D(2018, 8, 25)
    ebikes = fleet.first_seen_in_window(df, first, last)
    assert sorted(r["bike_number"] for r in ebikes.collect()) == ["1", "2"]
    doubled = ebikes.union(ebikes)
    got = by(fleet.ebike_fleet_calendar(df, doubled, first, D(2018, 8, 28)), "date")
    assert tuple(got[first].values())[1:] == (0, 1, 1, 1)
    assert tuple(got[D(2018, 8, 27)].values())[1:] == (2, 0, 2, 2)
    assert tuple(got[D(2018, 8, 28)].values())[1:] == (None, None, 2, 2)


def test_distance_means(spark):
    df = trips(
        spark,
        trip(at("08:00"), at("08:30"), start_station="a", end_station="b"),
        trip(at("08:00"), at("09:00"), start_station="a", end_station="a"),
        trip(at("08:00"), at("09:00"), start_station="a", end_station="x"),
    )
    named = stations(spark, ("a", "A", 38.9, -77.0), ("b", "B", 38.95, -77.0))
    measured = distance.trip_distance_speed(df, named, D(2018, 9, 5))
    assert measured.count() == 3
    mean = distance.avg_distance_speed_by_type(measured).first()
    assert mean["avg_miles"] == pytest.approx(3.4547, abs=1e-3)
    assert mean["avg_mph"] == pytest.approx(2 * mean["avg_miles"])
    assert mean["avg_minutes"] == pytest.approx(50.0)
    daily = distance.daily_distance_speed(measured).first()
    assert daily["avg_miles"] == pytest.approx(mean["avg_miles"] / 2)


def test_distance_density_reaches_the_longest_trip(spark):
    rows = [(k, m) for k, far in (("Classic", 40.0), ("Plus", 7.0)) for m in (0.0, 1.0, 2.0, far)]
    rows += [("Plus", None), ("Still", 0.0), ("Still", 0.0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "bike_type STRING, miles DOUBLE, trips LONG")
    got = by(distance.distance_density(df), "bike_type", "point")
    assert {k for k, _ in got} == {"Classic", "Plus"}
    for kind, far in (("Classic", 40.0), ("Plus", 7.0)):
        curve = [got[kind, i] for i in range(100)]
        assert curve[-1]["x"] > far and curve[0]["x"] < 0
        step = curve[1]["x"] - curve[0]["x"]
        assert sum(r["density"] for r in curve) * step == pytest.approx(1.0, abs=0.01)


def test_pair_distances_count_trips(spark):
    df = trips(
        spark,
        *[trip(at("08:00"), at("08:30"), start_station="a", end_station="b") for _ in range(3)],
        trip(at("08:00"), at("09:00"), start_station="a", end_station="x"),
    )
    named = stations(spark, ("a", "A", 38.9, -77.0), ("b", "B", 38.95, -77.0))
    got = dicts(distance.pair_distances(df, named, D(2018, 9, 5)))
    assert sorted((r["trips"], r["miles"] is None) for r in got) == [(1, True), (3, False)]


def test_distance_density_reads_the_trips_once(spark, tmp_path):
    trips(spark, *[trip(at("08:00"), at("08:30"), end_station=s) for s in "abc"]).write.parquet(
        str(tmp_path / "t")
    )
    named = stations(spark, ("a", "A", 38.9, -77.0), ("b", "B", 38.95, -77.0), ("c", "C", 39.0, -77.0))
    curve = distance.distance_density(
        distance.pair_distances(spark.read.parquet(str(tmp_path / "t")), named, D(2018, 9, 5))
    )
    assert len(curve.collect()) == 100
    final = plan(curve).split("== Initial Plan ==")[0]
    scans = final.count("FileScan") + final.count("Scan parquet")
    assert scans - final.count("ReusedExchange") <= 1


@pytest.mark.parametrize("small", [True, False])
def test_service_hours_bounds(spark, small):
    df = trips(
        spark,
        trip(at("09:30:00")),  # on a bound of two periods
        trip(at("19:00:00.5")),  # between two periods
        trip(at("19:00:00")),
        trip(at("23:59:59"), bike="E1", member="Other"),  # after the last period
        trip(at("09:00:00"), member="Other"),  # no type
        trip(at("09:00:00", D(2018, 9, 9))),  # a Sunday
        trip(at("09:00:00", D(2018, 9, 15))),  # a Saturday
        trip(at("09:00:00", D(2018, 9, 4))),  # too early
    )
    periods = hours(
        spark,
        (1, 0, 34200, "peak"),
        (1, 34200, 68400, "regular"),
        (1, 68401, 84600, "no_service"),
        (2, 0, 86399, "peak"),
    )
    counts = service_hours.trips_by_service_hours(df, periods, D(2018, 9, 5), small=small)
    got = by(counts, "trip_type", "day_of_week", "op_status")
    member = "Classic, Member"
    assert {k: (r["type_total"], r["trips"]) for k, r in got.items()} == {
        (member, 1, "peak"): (4, 1),
        (member, 1, "regular"): (4, 2),
        (member, None, None): (4, 1),
        ("Plus", None, None): (1, 1),
        (None, 1, "peak"): (None, 1),
    }
    shared = by(service_hours.service_hours_share(counts), "trip_type", "op_status")
    assert shared[member, "Regular Operating Hours"]["trip_share"] == 0.5
    assert shared[member, None]["trip_share"] == 0.25
    assert shared[None, "Peak Operating Hours"]["trip_share"] is None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_service_hours_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    periods = []
    for _ in range(25):
        start = rng.choice([rng.randrange(86_400), rng.randrange(24) * 3_600])
        end = start + rng.choice([0, 1, 3_600, rng.randrange(30_000), -60])
        periods.append((rng.randrange(7), start, min(end, 86_399), rng.choice("xyz")))
    rows = []
    for _ in range(300):
        at_second = rng.choice([rng.randrange(86_400), rng.choice(periods)[1]])
        day = dt.datetime(2018, 9, 10) + dt.timedelta(days=rng.randrange(7))
        rows.append(trip(day + dt.timedelta(seconds=at_second, microseconds=rng.choice([0, 0, 1]))))
    want = Counter()
    for _, start, *_ in rows:
        dow = start.isoweekday() % 7
        if dow in (0, 6):
            continue
        second = (start - start.replace(hour=0, minute=0, second=0, microsecond=0)).total_seconds()
        hit = [(d, s) for d, a, b, s in periods if d == dow and a <= second <= b]
        want.update(hit or [(None, None)])
    for small in (True, False):
        counts = service_hours.trips_by_service_hours(
            trips(spark, *rows), hours(spark, *periods), D(2018, 9, 5), small=small
        )
        got = by(counts, "day_of_week", "op_status")
        assert {k: r["trips"] for k, r in got.items()} == dict(want)
        assert {r["type_total"] for r in got.values()} == {sum(want.values())}


@pytest.mark.parametrize("seed", [1, 2])
def test_vehicle_kinds_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [
        (
            str(dt.datetime(2018, 3, 1) + dt.timedelta(hours=rng.randrange(24 * 20))),
            f"v{rng.randrange(40)}",
            rng.choice(["p", "p", "q"]),
            rng.choice([None, None, None, "bike", "scooter"]),
        )
        for _ in range(250)
    ]
    cutoff = D(2018, 3, 5)
    mine = [(dt.datetime.fromisoformat(c).date(), v, k) for c, v, p, k in rows if p == "p"]
    bikes = {v for d, v, k in mine if k == "bike" or d < cutoff}
    scooters = {v for _, v, k in mine if k == "scooter"}
    got = by(vehicles.daily_vehicle_kinds(locations(spark, *rows), "p", cutoff), "date")
    assert set(got) == {d for d, _, _ in mine}
    for d, r in got.items():
        seen = {v for day, v, _ in mine if day == d}
        assert (r["bikes"], r["scooters"], r["vehicles"]) == (
            len(seen & bikes),
            len(seen & scooters),
            len(seen),
        )


def test_unlabelled_status_becomes_null(spark):
    counts = spark.createDataFrame(
        [("Plus", 1, "odd", 2, 2)],
        "trip_type STRING, day_of_week INT, op_status STRING, type_total BIGINT, trips BIGINT",
    )
    assert service_hours.service_hours_share(counts).first()["op_status"] is None


def test_vehicle_kinds(spark):
    df = locations(
        spark,
        ("2018-03-01 10:00:00", "early", "p", None),
        ("2018-03-12 10:00:00", "early", "p", "scooter"),  # early and tagged: both kinds
        ("2018-03-12 11:00:00", "tagged", "p", None),
        ("2018-03-13 11:00:00", "tagged", "p", "bike"),
        ("2018-03-13 11:00:00", "late", "p", None),
        ("2018-03-12 11:00:00", "other", "q", "scooter"),
        ("2018-03-14 11:00:00", "late", "p", None),
        ("2018-03-14 12:00:00", None, "p", None),
    )
    daily = vehicles.daily_vehicle_kinds(df, "p", D(2018, 3, 10))
    got = {d: tuple(r.values())[1:] for d, r in by(daily, "date").items()}
    assert got == {
        D(2018, 3, 1): (1, 1, 1, -1),
        D(2018, 3, 12): (2, 1, 2, -1),
        D(2018, 3, 13): (1, 0, 2, 1),
        D(2018, 3, 14): (0, 0, 1, 1),
    }
    shared = vehicles.vehicle_kinds_apportioned(daily)
    rows = {d: (r["bikes"], r["scooters"]) for d, r in by(shared, "date").items()}
    assert rows == {
        D(2018, 3, 1): (0, 0),
        D(2018, 3, 12): (1, 0),
        D(2018, 3, 13): (2, 0),
        D(2018, 3, 14): (None, None),
    }
    events = [(D(2018, 3, 13), "bikes", "more"), (DAY, "bikes", "no")]
    long = by(vehicles.vehicle_kinds_long_events(shared, events), "date", "vehicle")
    assert len(long) == 8
    assert long[D(2018, 3, 13), "bikes"]["event"] == "more"
    assert long[D(2018, 3, 13), "scooters"]["event"] == ""
    assert {r["event"] for r in dicts(vehicles.vehicle_kinds_long_events(shared, []))} == {""}
    assert vehicles.total_scooters(df).first()["scooters"] == 2
    assert vehicles.total_vehicles(df, "p").first()["vehicles"] == 3


def test_a_tag_counts_however_its_name_is_spelt(spark):
    rows = [
        (dt.datetime(2018, 3, 12), "a", "p", '{"attributes":{"vehicle\\u005ftype":"scooter"}}'),
        (dt.datetime(2018, 3, 12), "b", "p", '{"attributes": {"vehicle_type": "scooter"}}'),
        (dt.datetime(2018, 3, 12), "c", "p", '{"vehicle_type":"scooter"}'),
        (dt.datetime(2018, 3, 12), "d", "p", None),
    ]
    df = spark.createDataFrame(rows, DEVICE_LOCATIONS)
    assert vehicles.total_scooters(df).first()["scooters"] == 2


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles"])
def test_vehicle_age_takes_tags_of_any_provider(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    df = locations(
        spark,
        ("2018-09-01 00:00:00", "s", "p", None),
        ("2018-09-03 12:00:00", "s", "p", None),
        ("2018-09-20 00:00:00", "s", "q", "scooter"),
        ("2018-09-14 00:00:00", "edge", "p", "scooter"),
        ("2018-09-14 12:00:00", "edge", "p", "scooter"),
        ("2018-09-14 00:00:01", "late", "p", "scooter"),
        ("2018-09-01 00:00:00", "bike", "p", "bike"),
        ("2018-09-01 00:00:00", "elsewhere", "q", "scooter"),
    )
    age = vehicles.avg_vehicle_age(df, "p", dt.datetime(2018, 9, 14)).first()
    assert age["avg_days"] == pytest.approx((2.5 + 0.5) / 2)
    none = vehicles.avg_vehicle_age(df.where(F.lit(False)), "p", dt.datetime(2018, 9, 14))
    assert none.first()["avg_days"] is None
    spark.conf.set("spark.sql.session.timeZone", "UTC")
