"""Aggregates kept beside tables, against the same reports over the tables themselves."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from helpers import dicts, locations, plan, trip, trips
from pyspark.sql import functions as F

from checks import registry
from spokeworks import jobs
from spokeworks.operators.staging import stage
from spokeworks.plans import durations, fleet, history, ingest, vehicle_history, vehicles
from spokeworks.schemas import STATION_NUMBER_LAYOUT
from spokeworks.sources import kept, tables

D = dt.date


def some_trips(spark, rng, n, days=40):
    rows = []
    for _ in range(n):
        start = dt.datetime(2018, 8, 20) + dt.timedelta(days=rng.randint(0, days), seconds=rng.randint(0, 86_399))
        end = start + dt.timedelta(seconds=rng.randint(-30, 4_000), microseconds=rng.randint(0, 999_999))
        bike = None if rng.random() < 0.05 else rng.choice("WwZ?E1") + str(rng.randint(0, 60))
        rows.append(trip(start, end, bike, rng.choice(["Member", "Casual", "Other"])))
    return trips(spark, *rows)


def append(spark, df, table, **more):
    numbered = df.withColumn("trip_id", F.monotonically_increasing_id())
    drop = registry._write_drop(numbered, STATION_NUMBER_LAYOUT, registry.STATION_NUMBER_HEADER)
    ingest.append_trips(spark, drop, table, **more)


def same(a, b):
    rows = [sorted(map(str, ({k: round(v, 9) if isinstance(v, float) else v for k, v in r.items()} for r in dicts(df)))) for df in (a, b)]
    assert rows[0] == rows[1] and rows[0]


def check_reports(spark, table):
    stored = tables.read_trips_table(spark, table)
    own = history.read_history(spark, table)
    first, last = D(2018, 8, 25), D(2018, 9, 20)
    same(fleet.daily_fleet_calendar(stored, first, last), fleet.daily_fleet_calendar(stored, first, last, kept=own))
    same(fleet.daily_fleet_trip_days(stored, first), fleet.daily_fleet_trip_days(stored, first, kept=own))
    for by_year in (False, True):
        same(durations.monthly_basic_stats(stored, first, by_year), history.monthly_basic_stats(own, first, by_year))
    return own


def test_reports_from_kept_aggregates_after_several_appends(spark, tmp_path):
    rng, table = random.Random(1), str(tmp_path / "trips")
    for n in (80, 1, 120):
        append(spark, some_trips(spark, rng, n), table)
    own = check_reports(spark, table)
    chain, upto = kept.spans(spark, f"{table}_history/sets")
    assert upto == 201 and chain == ["first_to_80", "80_to_81", "81_to_201"]
    stored = tables.read_trips_table(spark, table)
    read = fleet.daily_fleet_calendar(stored, D(2018, 8, 25), D(2018, 9, 20), kept=own).inputFiles()
    assert read and all(f"{table}_history/" in f for f in read)  # no trips
    ids = spark.read.parquet(f"{table}_history/bikes")
    assert ids.count() == ids.select("bike_id").distinct().count() == ids.select("bike_number").distinct().count()
    history.compact(spark, table)
    assert kept.spans(spark, f"{table}_history/sets") == (["first_to_201"], 201)
    check_reports(spark, table)
    append(spark, some_trips(spark, rng, 30), table)
    check_reports(spark, table)


def test_a_span_reads_its_own_trips_only(spark, tmp_path, monkeypatch):
    rng, table = random.Random(2), str(tmp_path / "trips")
    append(spark, some_trips(spark, rng, 50), table)
    seen = []
    real = history.by_day_and_bike
    monkeypatch.setattr(history, "by_day_and_bike", lambda df: seen.append(df) or real(df))
    append(spark, some_trips(spark, rng, 20), table)
    assert [df.count() for df in seen] == [20]
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(trip_id,50\)", plan(seen[0]))


def test_trips_without_history_are_one_span_and_a_lost_one_is_made_anew(spark, tmp_path, monkeypatch):
    rng, table = random.Random(3), str(tmp_path / "trips")
    append(spark, some_trips(spark, rng, 40), table, keep=False)
    append(spark, some_trips(spark, rng, 10), table, keep=False)
    assert history.read_history(spark, table) is None

    def dies(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(history, "_usage", dies)
        with pytest.raises(RuntimeError):
            append(spark, some_trips(spark, rng, 5), table)
    assert history.read_history(spark, table) is None  # the trips are there, their span isn't
    jobs.run(spark, jobs._arguments(["history", "--tables", str(tmp_path)]))
    check_reports(spark, table)
    assert kept.spans(spark, f"{table}_history/sets")[0] == ["first_to_55"]
    append(spark, some_trips(spark, rng, 5), table, keep=False)
    assert history.read_history(spark, table) is None  # stale, so reports read the trips
    jobs.run(spark, jobs._arguments(["history", "--tables", str(tmp_path), "--compact"]))
    check_reports(spark, table)


def test_numbers_of_bikes_stay_dense(spark, monkeypatch):
    monkeypatch.setattr(history, "BITS", 4)
    bikes = spark.range(100).select(F.format_string("b%d", "id").alias("bike_number"))
    none = spark.createDataFrame([], "bike_number STRING, bike_id LONG, bucket INT")
    first = history.number_bikes(bikes.where("bike_number < 'b5'"), none)
    both = first.unionByName(history.number_bikes(bikes, first))
    rows = dicts(both)
    assert len(rows) == 100 and len({r["bike_id"] for r in rows}) == 100
    for bucket in range(history.BUCKETS):
        own = sorted(r["bike_id"] - 1 for r in rows if r["bucket"] == bucket)
        assert own == [(k // 4 * history.BUCKETS + bucket) * 4 + k % 4 for k in range(len(own))]


def years_drop(folder, **rows):
    folder.mkdir()
    header = ",".join(f'"{h}"' for h in registry.STATION_ID_HEADER)
    for name, trips_ in rows.items():
        lines = [f'60,"{start}","{start}",1,"A",1,1,2,"B",1,1,{bike},"Subscriber","",1' for start, bike in trips_]
        (folder / f"{name[1:]}.csv").write_text("\n".join([header, *lines]) + "\n")
    return str(folder)


def test_bikes_of_a_table_by_years(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "second_trips")
    one = years_drop(tmp_path / "one", y2017=[("2017-03-01 08:00:00", 1), ("2017-05-01 08:00:00", 2)], y2018=[("2018-08-21 08:00:00", 3), ("2018-09-09 09:00:00", 1), ("2018-08-22 08:00:00", "")])
    ingest.ingest_trips_by_year(spark, one, table, [2017, 2018])
    stored = lambda: tables.read_table(spark, table, registry.TRIPS)
    window = (D(2018, 8, 20), D(2018, 8, 25))
    ebikes = spark.createDataFrame([("3",)], "bike_number STRING")

    def check():
        lives = history.read_year_lives(spark, table)
        same(fleet.first_seen_in_window(stored(), *window), fleet.first_seen_in_window(stored(), *window, lives))
        period = (D(2017, 2, 1), D(2018, 12, 1))
        same(fleet.ebike_fleet_calendar(stored(), ebikes, *period), fleet.ebike_fleet_calendar(stored(), ebikes, *period, lives=lives))
        assert all("second_trips_history/" in f for f in fleet.first_seen_in_window(stored(), *window, lives).inputFiles())

    check()
    two = years_drop(tmp_path / "two", y2017=[("2017-03-01 08:00:00", 3)])  # bike 3 is older than was known

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(history, "keep_years", dies)
        with pytest.raises(RuntimeError):
            ingest.ingest_trips_by_year(spark, two, table, [2017])
    assert history.read_year_lives(spark, table) is None  # a year is new, and its bikes aren't kept yet
    ingest.ingest_trips_by_year(spark, two, table, [2017])
    check()
    assert [r["bike_number"] for r in dicts(fleet.first_seen_in_window(stored(), *window))] == [None]


BEFORE = D(2018, 3, 10)


def some_locations(rng, n):
    rows = []
    for _ in range(n):
        created = dt.datetime(2018, 3, 5) + dt.timedelta(days=rng.randint(0, 12), seconds=rng.randint(0, 86_399))
        bike = None if rng.random() < 0.04 else f"v{rng.randint(0, 25)}"
        kind = rng.choice([None] * 12 + ["bike", "scooter", "moped"])
        rows.append((str(created), bike, rng.choice(["a", "a", "b"]), kind))
    return rows


def check_kinds(spark, rows, own):
    every = locations(spark, *rows)
    for provider in ("a", "b"):
        same(vehicles.daily_vehicle_kinds(every, provider, BEFORE), own.daily_kinds(provider))
        same(vehicles.total_vehicles(every, provider), own.total_vehicles(provider))
        limit = dt.datetime(2018, 3, 14)
        same(vehicles.avg_vehicle_age(every, provider, limit), own.avg_vehicle_age(provider, limit))
    same(vehicles.total_scooters(every), own.total_scooters())


def test_late_tags_and_earlier_sightings_are_taken_back(spark, tmp_path):
    rng = random.Random(4)
    own = vehicle_history.VehicleHistory(spark, str(tmp_path / "h"), BEFORE)
    rows = []
    for n, size in enumerate((60, 90, 1, 120)):
        batch = some_locations(rng, size)
        own.add(locations(spark, *batch), f"{n}")
        own.add(locations(spark, *batch), f"{n}")  # run again: nothing more
        rows += batch
        check_kinds(spark, rows, own)
    counts = spark.read.parquet(f"{tmp_path}/h/before_{BEFORE}/counts")
    assert counts.where("bikes < 0 OR scooters > vehicles OR vehicles = 0").count() > 0  # days were taken back


def test_no_vehicles_are_broadcast(spark):
    rows = [locations(spark, *some_locations(random.Random(n), 60)) for n in (7, 8)]
    first, second = (stage(vehicle_history.batch_days(df), "days") for df in rows)
    flags = stage(vehicle_history.merged_flags(first, "date"), "flags")
    counts, added = vehicle_history.step(second, flags, first, BEFORE)
    for df in (counts, added):
        assert "SortMergeJoin" in plan(df) and "Broadcast" not in plan(df)


def test_only_buckets_of_touched_vehicles_are_read(spark, tmp_path, monkeypatch):
    own = vehicle_history.VehicleHistory(spark, str(tmp_path / "h"), BEFORE)
    rng = random.Random(5)
    rows = some_locations(rng, 200)
    own.add(locations(spark, *rows), "0")
    seen = []
    real = vehicle_history.step
    monkeypatch.setattr(vehicle_history, "step", lambda *a: seen.append(a) or real(*a))
    late = [("2018-03-01 00:00:00", "v3", "a", "scooter")]
    own.add(locations(spark, *late), "1")
    _, flags, days, _ = seen[0]
    for df in (flags, days):
        text = plan(df)
        assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|=)", text) and df.select("bucket").distinct().count() == 1
    check_kinds(spark, rows + late, own)


def test_a_batch_that_died_is_made_anew(spark, tmp_path, monkeypatch):
    own = vehicle_history.VehicleHistory(spark, str(tmp_path / "h"), BEFORE)
    rng = random.Random(6)
    one, two = some_locations(rng, 50), some_locations(rng, 70)
    own.add(locations(spark, *one), "0")
    real = kept.put
    with monkeypatch.context() as m:
        def dies(df, path, *more):
            if path.endswith("counts"):
                raise RuntimeError("lost")
            real(df, path, *more)

        m.setattr(vehicle_history.kept, "put", dies)
        with pytest.raises(RuntimeError):
            own.add(locations(spark, *two), "1")
    check_kinds(spark, one, own)
    own.add(locations(spark, *two), "1")
    check_kinds(spark, one + two, own)


def test_locations_are_added_by_drops_and_reports_take_the_history(spark, tmp_path):
    rng, root = random.Random(7), str(tmp_path / "tables")
    rows = []
    for n in range(2):
        batch = some_locations(rng, 60)
        tables.export_csv(locations(spark, *batch), f"{tmp_path}/d{n}", "|")
        for _ in range(2):
            jobs.run(spark, jobs._arguments(["locations", "--source", f"{tmp_path}/d{n}", "--tables", root]))
        rows += batch
    folder = jobs.TableFolder(spark, root)
    assert folder.bike_locations().count() == len(rows)
    check_kinds(spark, rows, folder.vehicle_history(BEFORE))
    assert folder.vehicle_history(D(2018, 1, 1)) is None
    jobs.run(spark, jobs._arguments(["report", "daily_vehicle_kinds", "--provider", "a", "--tables", root, "--out", f"{tmp_path}/r"]))
    assert spark.read.option("header", True).csv(f"{tmp_path}/r").count() == vehicles.daily_vehicle_kinds(locations(spark, *rows), "a", BEFORE).count()
