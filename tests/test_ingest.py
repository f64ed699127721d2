from __future__ import annotations

import datetime as dt
import inspect
import json
import os
import re
import threading
from functools import reduce

import pytest
from helpers import by, dicts, plan, stations, trip, trips
from pyspark.sql import functions as F

from checks import registry
from spokeworks import jobs, reports
from spokeworks.operators import rowids
from spokeworks.operators.conform import repeated_keys, require_new_keys
from spokeworks.operators.staging import stage
from spokeworks.plans import ingest
from spokeworks.plans.selections import within
from spokeworks.schemas import (
    NUMBERED_TRIPS,
    REGIONS,
    STATION_ID_LAYOUT,
    STATIONS,
    TRIPS,
    WEATHER,
)
from spokeworks.reports import REPORTS
from spokeworks.sources import files
from spokeworks.sources.snapshots import read_station_snapshot
from spokeworks.sources.tables import (
    append_table,
    append_trips_table,
    export_csv,
    largest_stored,
    last_id,
    load_delimited,
    read_delimited,
    read_table,
    replace_partitions,
    replace_table,
    stored_last_id,
)
from spokeworks.sources.trips import read_positioned_trips, read_trips

D = dt.date


NUMBER_HEADER = registry.STATION_NUMBER_HEADER
ID_HEADER = registry.STATION_ID_HEADER


def write_drop(folder, name, rows, header=NUMBER_HEADER):
    folder.mkdir(exist_ok=True)
    lines = [",".join(f'"{h}"' for h in header)]
    lines += [",".join(f'"{v}"' if v is not None else "" for v in row) for row in rows]
    (folder / name).write_text("\n".join(lines) + "\n")


def numbered(start, n, day="2018-09-05"):
    return [
        (60, f"{day} 08:00:00", f"{day} 08:01:00", "31001", "A, St", "31002", "B", f"W{i}", "Member")
        for i in range(start, start + n)
    ]


def test_read_first_layout(spark, tmp_path):
    write_drop(tmp_path / "d", "b.csv", [
        (9, "2018-09-05 00:00:01", "2018-09-05 00:00:10", 31001, "A, St", 31002, "B", "W1", "Member"),
        (None, "2018-09-05 00:00:01", "2018-09-05 00:00:10", None, "A", 31002, "B", None, "Casual"),
    ])
    (tmp_path / "d" / "notes.txt").write_text("not a trip file")
    got = read_trips(spark, str(tmp_path / "d"))
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in TRIPS]
    rows = dicts(got)
    assert rows[0]["start_station"] == "31001"
    assert rows[0]["start_date"] == dt.datetime(2018, 9, 5, 0, 0, 1)
    assert rows[1]["duration"] is None and rows[1]["bike_number"] is None


def test_a_different_header_is_an_error(spark, tmp_path):
    header = list(NUMBER_HEADER)
    header[3], header[4] = header[4], header[3]
    write_drop(tmp_path / "d", "a.csv", numbered(0, 1))
    write_drop(tmp_path / "d", "b.csv", numbered(1, 1), header)
    with pytest.raises(Exception, match="header"):
        read_trips(spark, str(tmp_path / "d")).collect()


def test_columns_are_renamed_by_place_or_picked_by_name(spark, tmp_path):
    names = ["Total (ms)", "Start", "End", "From", "Start station", "To", "End station", "Bike", "Who"]
    write_drop(tmp_path / "a", "a.csv", numbered(5, 1), names)
    assert read_trips(spark, str(tmp_path / "a")).first()["bike_number"] == "W5"
    turned = [*ID_HEADER[::-1], "more"]
    rows = [(*second_row("2013-07-01 00:00:00", 9)[::-1], "x")]
    write_drop(tmp_path / "b", "b.csv", rows, turned)
    row = read_trips(spark, str(tmp_path / "b"), STATION_ID_LAYOUT).first()
    assert (row["bike_number"], row["start_station"]) == ("9", "1")
    write_drop(tmp_path / "c", "c.csv", [(1, 2)], ["a", "b"])
    with pytest.raises(ValueError, match="does not fit"):
        read_trips(spark, str(tmp_path / "c"))


def test_ids_follow_file_names_then_rows_and_continue(spark, tmp_path):
    write_drop(tmp_path / "one", "201810.csv", numbered(700, 400))
    write_drop(tmp_path / "one", "201809.csv", numbered(0, 700))
    write_drop(tmp_path / "two", "201811.csv", numbered(1_100, 50))
    table = str(tmp_path / "trips")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")  # several splits per file
    try:
        ingest.append_trips(spark, str(tmp_path / "one"), table)
        assert last_id(read_table(spark, table, NUMBERED_TRIPS), "trip_id") == 1_100
        ingest.append_trips(spark, str(tmp_path / "two"), table)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = dicts(read_table(spark, table, NUMBERED_TRIPS))
    assert sorted(r["trip_id"] for r in got) == list(range(1, 1_151))
    assert all(r["bike_number"] == f"W{r['trip_id'] - 1}" for r in got)


def surplus(folder, name, extra):
    """A drop whose second row has ``extra`` fields more (or fewer) than the header."""
    write_drop(folder, name, numbered(0, 3))
    lines = (folder / name).read_text().splitlines()
    lines[2] = lines[2] + ',"x"' * extra if extra > 0 else lines[2].rsplit(",", -extra)[0]
    (folder / name).write_text("\n".join(lines) + "\n")


@pytest.mark.parametrize("extra", [1, 2, -1, -3])
def test_rows_of_another_length_are_errors(spark, tmp_path, extra):
    surplus(tmp_path / "d", "a.csv", extra)
    for few in (["bike_number"], ["start_date", "duration"], TRIPS.names):
        with pytest.raises(Exception, match="(?i)malformed"):
            read_trips(spark, str(tmp_path / "d")).select(*few).collect()
    with pytest.raises(Exception, match="(?i)malformed"):
        ingest.append_trips(spark, str(tmp_path / "d"), str(tmp_path / "t"))


def test_a_shifted_row_is_an_error(spark, tmp_path):
    write_drop(tmp_path / "d", "a.csv", numbered(0, 2))
    text = (tmp_path / "d" / "a.csv").read_text().replace('"A, St"', "A, St", 1)
    (tmp_path / "d" / "a.csv").write_text(text)
    with pytest.raises(Exception, match="(?i)malformed"):
        read_trips(spark, str(tmp_path / "d")).collect()


def staged(spark):
    from spokeworks.operators.staging import staging_root

    return set(os.listdir(staging_root(spark)))


def test_a_drop_is_added_once_and_its_copies_go(spark, tmp_path):
    table = str(tmp_path / "t")
    write_drop(tmp_path / "d", "a.csv", numbered(0, 5))
    before = staged(spark)
    for _ in range(2):
        ingest.append_trips(spark, str(tmp_path / "d"), table)
    assert staged(spark) == before
    assert read_table(spark, table, NUMBERED_TRIPS).count() == 5
    write_drop(tmp_path / "d", "b.csv", numbered(5, 5))
    with pytest.raises(ValueError, match="a.csv"):  # an old file among new ones
        ingest.append_trips(spark, str(tmp_path / "d"), table)
    (tmp_path / "e").mkdir()
    with pytest.raises(ValueError, match="no files"):
        ingest.append_trips(spark, str(tmp_path / "e"), table)


def test_an_append_that_died_is_run_again(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "t")
    write_drop(tmp_path / "d", "a.csv", numbered(0, 5))
    write_drop(tmp_path / "other", "b.csv", numbered(5, 2))

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:  # before the rows were written
        m.setattr(ingest, "append_trips_table", dies)
        with pytest.raises(RuntimeError):
            ingest.append_trips(spark, str(tmp_path / "d"), table)
    with pytest.raises(ValueError, match="another drop"):
        ingest.append_trips(spark, str(tmp_path / "other"), table)
    with monkeypatch.context() as m:  # after the rows were written
        m.setattr(ingest.drops, "finish", dies)
        with pytest.raises(RuntimeError):
            ingest.append_trips(spark, str(tmp_path / "d"), table)
    ingest.append_trips(spark, str(tmp_path / "d"), table)
    ingest.append_trips(spark, str(tmp_path / "other"), table)
    got = dicts(read_table(spark, table, NUMBERED_TRIPS))
    assert sorted(r["trip_id"] for r in got) == list(range(1, 8))


def test_of_two_appends_at_once_one_is_refused(spark, tmp_path, monkeypatch):
    """Each thread waits, once ids are being given, until the other was refused."""
    table = str(tmp_path / "t")
    write_drop(tmp_path / "one", "a.csv", numbered(0, 30))
    write_drop(tmp_path / "two", "b.csv", numbered(30, 20))
    errors, begun, refused = [], threading.Event(), threading.Event()
    real = ingest.numbered_trips

    def slow(*args):
        begun.set()
        assert refused.wait(60)
        return real(*args)

    monkeypatch.setattr(ingest, "numbered_trips", slow)
    first = threading.Thread(target=lambda: ingest.append_trips(spark, f"{tmp_path}/one", table))
    first.start()
    assert begun.wait(60)
    for name in ("two", "one"):
        with pytest.raises(ValueError, match="another job"):
            ingest.append_trips(spark, f"{tmp_path}/{name}", table)
        errors.append(name)
    refused.set()
    first.join()
    ingest.append_trips(spark, f"{tmp_path}/two", table)
    assert sorted(r["trip_id"] for r in dicts(read_table(spark, table, NUMBERED_TRIPS))) == list(range(1, 51))


def test_a_claim_can_be_made_once(spark, tmp_path):
    wins = []
    start = threading.Barrier(8)

    def claim(k):
        start.wait()
        if files.create_once(spark, f"{tmp_path}/x/claim", str(k)):
            wins.append(k)

    for _ in range(5):
        threads = [threading.Thread(target=claim, args=(k,)) for k in range(8)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        assert [files.read_text(spark, f"{tmp_path}/x/claim")] == [str(k) for k in wins]
        files.remove(spark, f"{tmp_path}/x/claim")
        wins.clear()


def test_the_claim_of_a_killed_job_is_taken_over_on_demand(spark, tmp_path):
    table = str(tmp_path / "t")
    write_drop(tmp_path / "d", "a.csv", numbered(0, 5))
    files.create_once(spark, f"{table}__claim", "killed")
    with pytest.raises(ValueError, match="resume"):
        ingest.append_trips(spark, str(tmp_path / "d"), table)
    ingest.append_trips(spark, str(tmp_path / "d"), table, resume=True)
    assert read_table(spark, table, NUMBERED_TRIPS).count() == 5
    assert not files.exists(spark, f"{table}__claim")


def with_bad_rows(folder, name, n):
    """A drop in which every fifth row is no trip."""
    write_drop(folder, name, numbered(0, n))
    lines = (folder / name).read_text().splitlines()
    bad = {}
    for i in range(4, n, 5):
        line = lines[i + 1]
        reason = ["fields", "fields", "duration", "start_date", "end_date"][i // 5 % 5]
        fields = line.split('","')
        if reason == "fields":
            line = line + ',"x"' if i % 2 else ",".join(f'"{x.strip(chr(34))}"' for x in fields[:4])
        else:
            fields[["duration", "start_date", "end_date"].index(reason)] = '"1.5e' if reason == "duration" else "2018-13-01 00:00"
            line = '","'.join(fields)
        lines[i + 1] = line
        bad[i] = reason
    (folder / name).write_text("\n".join(lines) + "\n")
    return bad


def test_other_writers_need_the_claim_too(spark, tmp_path):
    table = str(tmp_path / "t")
    files.create_once(spark, f"{table}__claim", "another")
    rows = stations(spark, ("a", "A", 1.0, 1.0))
    with pytest.raises(ValueError, match="another job"):
        replace_table(rows, table, STATIONS)
    with pytest.raises(ValueError, match="another job"):
        replace_partitions(rows.withColumn("y", F.lit(1)), table, STATIONS, "y")
    weather_day(tmp_path / "w", D(2018, 10, 1))
    with pytest.raises(ValueError, match="another job"):
        ingest.ingest_weather(spark, str(tmp_path / "w"), table)
    files.remove(spark, f"{table}__claim")
    replace_table(rows, table, STATIONS)
    assert read_table(spark, table, STATIONS).count() == 1 and not files.exists(spark, f"{table}__claim")


def test_rows_that_are_no_trips_are_set_aside(spark, tmp_path):
    table = str(tmp_path / "t")
    bad = with_bad_rows(tmp_path / "d", "a b.csv", 100)
    write_drop(tmp_path / "d", "b.csv", numbered(100, 20))
    with pytest.raises(Exception, match="(?i)malformed"):
        ingest.append_trips(spark, str(tmp_path / "d"), table)
    with pytest.raises(ValueError, match="20 of 120"):
        ingest.append_trips(spark, str(tmp_path / "d"), table, most_bad=0.1)
    assert read_table(spark, table, NUMBERED_TRIPS).count() == 0
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # several splits
    try:
        for _ in range(2):
            ingest.append_trips(spark, str(tmp_path / "d"), table, most_bad=0.2)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = sorted(dicts(read_table(spark, table, NUMBERED_TRIPS)), key=lambda r: r["trip_id"])
    assert [r["trip_id"] for r in got] == list(range(1, 101))
    assert [r["bike_number"] for r in got] == [f"W{i}" for i in range(120) if i not in bad]
    rejected = dicts(spark.read.parquet(ingest.rejected_path(table)))
    assert sorted(r["reason"] for r in rejected) == sorted(bad.values())
    assert all(r["file"].endswith("/a b.csv") and len(r["record"]) > 10 for r in rejected)


def test_without_bad_rows_nothing_is_set_aside(spark, tmp_path):
    write_drop(tmp_path / "d", "a.csv", [
        (None, "9/5/2018 0:01", "9/5/2018 10:01:05", None, "A", 31002, "B", None, "Casual"),
        (5, "2018-09-05 00:00:01.25", None, 31001, "A, St", 31002, 'say ""x""', "W1", "Member"),
    ])
    strict, checked = str(tmp_path / "s"), str(tmp_path / "c")
    ingest.append_trips(spark, str(tmp_path / "d"), strict)
    ingest.append_trips(spark, str(tmp_path / "d"), checked, most_bad=0.0)
    rows = [sorted(map(str, dicts(read_table(spark, t, NUMBERED_TRIPS)))) for t in (strict, checked)]
    assert rows[0] == rows[1] and len(rows[0]) == 2
    assert not (tmp_path / "c_rejected").exists()


def test_a_replacement_that_dies_leaves_the_old_table(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "t")
    old = stations(spark, ("a", "A", 1.0, 1.0))
    new = stations(spark, ("b", "B", 2.0, 2.0), ("c", "C", 2.0, 2.0))
    replace_table(old, table, STATIONS)
    names = lambda: sorted(r["name"] for r in dicts(read_table(spark, table, STATIONS)))
    with pytest.raises(Exception, match="torn"):  # while it is written
        replace_table(new.withColumn("name", F.raise_error(F.lit("torn"))), table, STATIONS)
    assert names() == ["A"]
    with pytest.raises(ValueError, match="station_id"):
        replace_table(new.unionByName(new), table, STATIONS, key=["station_id"])
    assert names() == ["A"]
    real = files.move
    for dies_at, left in ((1, ["A"]), (2, ["A"])):
        moves = []

        def move(*args, dies_at=dies_at, moves=moves):
            moves.append(args)
            if len(moves) == dies_at:
                raise RuntimeError("lost")
            real(*args)

        with monkeypatch.context() as m:
            m.setattr(files, "move", move)
            with pytest.raises(RuntimeError):
                replace_table(new, table, STATIONS)
        assert names() == left
    # rows made of the table itself, which for now lies under its other name
    grown = read_table(spark, table, STATIONS).unionByName(new)
    replace_table(grown, table, STATIONS)
    assert names() == ["A", "B", "C"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_partitions_are_published_at_once(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "t")

    def rows(*years, bike):
        parts = [trips(spark, trip(f"{y}-07-01 08:00:00", bike=bike)).withColumn("y", F.lit(y)) for y in years]
        return reduce(lambda a, b: a.unionByName(b), parts)

    def stored():
        return {r["start_date"].year: r["bike_number"] for r in dicts(read_table(spark, table, TRIPS))}

    replace_partitions(rows(2013, 2014, 2015, bike="old"), table, TRIPS, "y")
    with pytest.raises(Exception, match="torn"):
        torn = rows(2014, 2015, bike="new").withColumn("bike_number", F.raise_error(F.lit("torn")))
        replace_partitions(torn, table, TRIPS, "y")
    assert stored() == dict.fromkeys((2013, 2014, 2015), "old")
    real = files.move
    moves = []

    def move(*args):
        moves.append(args)
        if len(moves) == 2:
            raise RuntimeError("lost")
        real(*args)

    with monkeypatch.context() as m:
        m.setattr(files, "move", move)
        with pytest.raises(RuntimeError):
            replace_partitions(rows(2014, 2015, bike="new"), table, TRIPS, "y")
    assert stored() == {2013: "old", 2014: "new", 2015: "new"}  # one is moved, one isn't
    replace_partitions(rows(2016, bike="later"), table, TRIPS, "y")  # finishes the other one first
    assert stored() == {2013: "old", 2014: "new", 2015: "new", 2016: "later"}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_the_last_id_comes_from_footers(spark, tmp_path):
    table = str(tmp_path / "t")
    assert stored_last_id(spark, table, NUMBERED_TRIPS, "trip_id") == 0
    for ids in ((5, 9), (7, 3)):
        rows = trips(spark, trip("2018-09-05 08:00:00"), trip("2018-10-05 08:00:00"))
        numbers = F.when(F.month("start_date") == 9, ids[0]).otherwise(ids[1])
        append_trips_table(rows.withColumn("trip_id", numbers), table)
    assert stored_last_id(spark, table, NUMBERED_TRIPS, "trip_id") == 9
    text = plan(largest_stored(spark, table, "trip_id"))
    assert "PushedAggregation: [MAX(trip_id)]" in text


def test_only_new_keys_are_grouped(spark, tmp_path):
    stored = spark.createDataFrame([(i, "x") for i in range(50)], "k LONG, v STRING")
    stored.write.parquet(f"{tmp_path}/s")
    stored = spark.read.parquet(f"{tmp_path}/s")
    new = spark.createDataFrame([(60, "a"), (61, "a")], "k LONG, v STRING")
    assert require_new_keys(new, stored, ["k"]) is new
    for bad in ([(60, "a"), (60, "b")], [(None, "a")], [(7, "a"), (60, "a")]):
        with pytest.raises(ValueError, match="is not a key"):
            require_new_keys(spark.createDataFrame(bad, new.schema), stored, ["k"])
    text = plan(repeated_keys(new, stored, ["k"]))
    above = text[: text.index("FileScan")].rpartition("LeftSemi")[2]
    assert "LeftSemi" in text and "Aggregate" not in above and "Exchange" not in above


def test_absent_columns_are_errors(spark, tmp_path):
    table = str(tmp_path / "t")
    append_table(trips(spark, trip("2018-09-05 08:00:00")), table, TRIPS)
    with pytest.raises(ValueError, match="trip_id"):
        read_table(spark, table, NUMBERED_TRIPS)
    assert read_table(spark, table, NUMBERED_TRIPS, may_lack=["trip_id"]).first()["trip_id"] is None
    write_drop(tmp_path / "d", "a.csv", numbered(0, 1))
    with pytest.raises(ValueError, match="trip_id"):
        ingest.append_trips(spark, str(tmp_path / "d"), table)
    (tmp_path / "broken").mkdir()
    with pytest.raises(ValueError, match="broke off"):
        read_table(spark, str(tmp_path / "broken"), TRIPS)


def test_file_names_sort_as_written(spark, tmp_path):
    names = ["a!.csv", "a é.csv", "a+b.csv", "a%20c.csv", "a b.csv", "é.csv", "z.csv", "A.csv"]
    for i, name in enumerate(sorted(names)):
        write_drop(tmp_path / "d", name, numbered(i * 3, 3))
    got = dicts(ingest.numbered_trips(spark, str(tmp_path / "d"), 0))
    assert sorted(r["trip_id"] for r in got) == list(range(1, 25))
    assert all(r["bike_number"] == f"W{r['trip_id'] - 1}" for r in got)


@pytest.mark.parametrize("listed", [True, False])
def test_ids_when_tasks_read_several_files(spark, tmp_path, monkeypatch, listed):
    for i in range(40):
        write_drop(tmp_path / "d", f"{i:02d}.csv", numbered(i * 10, 10))
    if not listed:  # a list of splits too long to broadcast
        monkeypatch.setattr(rowids, "SPLITS", 0)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        placed = stage(read_positioned_trips(spark, str(tmp_path / "d")), "placed")
        tasks = placed.select(F.shiftright(rowids.SEQUENCE, 33)).distinct().count()
        got = dicts(rowids.number_rows(placed, 1_000, "trip_id"))
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert tasks < 40
    assert sorted(r["trip_id"] for r in got) == list(range(1_001, 1_401))
    assert all(r["bike_number"] == f"W{r['trip_id'] - 1_001}" for r in got)


def test_last_id_of_an_empty_table(spark, tmp_path):
    assert last_id(read_table(spark, str(tmp_path / "none"), NUMBERED_TRIPS), "trip_id") == 0


def second_row(start, bike):
    return (60, start, start, 1, "A", 38.0, -77.0, 2, "B", 38.0, -77.0, bike, "Subscriber", "", 1)


def test_years_are_partitions_that_a_rerun_replaces(spark, tmp_path):
    header = ID_HEADER
    write_drop(tmp_path / "d", "2013-07 trips.csv", [second_row("2013-07-01 00:00:00", 1)], header)
    write_drop(tmp_path / "d", "2014-09 trips.csv", [second_row("9/1/2014 00:00:05", 2)] * 2, header)
    write_drop(tmp_path / "d", "2015-09 trips.csv", [second_row("9/1/2015 0:05", 3)], header)
    table = str(tmp_path / "t")
    with pytest.raises(ValueError, match="2012"):
        ingest.ingest_trips_by_year(spark, str(tmp_path / "d"), table, [2012, 2013])
    for _ in range(2):
        ingest.ingest_trips_by_year(
            spark, str(tmp_path / "d"), table, [2012, 2013, 2014], missing_ok=True
        )
    files = [p for p in (tmp_path / "t").rglob("*.parquet")]
    assert len(files) == 2  # one per year, however many tasks there were
    stored = spark.read.parquet(table)
    assert {r["file_year"]: r["count"] for r in dicts(stored.groupBy("file_year").count())} == {
        2013: 1,
        2014: 2,
    }
    (tmp_path / "d" / "notes 2015.txt").write_text("not a trip file")
    ingest.ingest_trips_by_year(spark, str(tmp_path / "d"), table, [2015])
    assert read_table(spark, table, TRIPS).count() == 4
    third = stored.sparkSession.read.parquet(table).where("file_year = 2015").first()
    assert third["start_date"] == dt.datetime(2015, 9, 1, 0, 5)


def test_years_are_stored_without_a_shuffle(spark, tmp_path, monkeypatch):
    kind, hints = type(spark.range(1)), []
    real = kind.hint
    monkeypatch.setattr(kind, "hint", lambda df, name, *more: hints.append(name) or real(df, name, *more))
    monkeypatch.setattr(ingest, "YEAR_BYTES", 200)
    write_drop(tmp_path / "d", "2013-2014.csv", [second_row("2013-12-31 23:00:00", 1)], ID_HEADER)
    for n in range(4):
        write_drop(tmp_path / "d", f"2014-0{n + 1}.csv", [second_row(f"2014-0{n + 1}-01 08:00:00", n)], ID_HEADER)
    ingest.ingest_trips_by_year(spark, str(tmp_path / "d"), str(tmp_path / "t"), [2013, 2014])
    assert "rebalance" not in hints
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert {r["file_year"]: r["count"] for r in dicts(stored.groupBy("file_year").count())} == {2013: 1, 2014: 4}


def snapshot(tmp_path, *entries):
    path = tmp_path / "stations.json"
    path.write_text(json.dumps({"ttl": 10, "data": {"stations": list(entries)}}, indent=2))
    return str(path)


def entry(short, name, station_id, **more):
    return {
        "capacity": 5, "lat": 38.9, "lon": -77.0, "name": name, "short_name": short,
        "station_id": station_id, **more,
    }


def test_new_snapshot_wins_and_missing_region_has_a_default(spark, tmp_path):
    table = str(tmp_path / "t")
    replace_table(
        stations(spark, ("a", "old a", 1.0, 1.0), ("c", "old c", 1.0, 1.0), (None, "old", 1.0, 1.0)),
        table,
        STATIONS,
    )
    path = snapshot(
        tmp_path,
        entry("b", "new b", "101", region_id=41),
        entry("a", "new a", "102", rental_methods=["KEY"]),
        entry("a", "second a", "50"),
    )
    assert [r["position"] for r in dicts(read_station_snapshot(spark, path))] == [0, 1, 2]
    ingest.upsert_stations(spark, path, table)
    got = by(read_table(spark, table, STATIONS), "short_name")
    assert {k: r["name"] for k, r in got.items()} == {
        "a": "new a", "b": "new b", "c": "old c", None: "old",
    }
    assert (got["a"]["region_id"], got["b"]["region_id"]) == (42, 41)
    ingest.upsert_stations(spark, path, table)
    assert read_table(spark, table, STATIONS).count() == 4


def test_stations_without_short_name_count_as_one(spark):
    stored = stations(spark, (None, "x", 1.0, 1.0), (None, "y", 1.0, 1.0))
    none = stored.where(F.lit(False)).withColumn("position", F.lit(0))
    assert [r["name"] for r in dicts(ingest.merge_stations(none, stored))] == ["x"]


def test_station_ids_must_be_unique(spark, tmp_path):
    path = snapshot(tmp_path, entry("a", "a", "1"), entry("b", "b", "1"))
    with pytest.raises(ValueError, match="station_id"):
        ingest.upsert_stations(spark, path, str(tmp_path / "t"))


def test_regions_get_codes(spark, tmp_path):
    path = tmp_path / "regions.json"
    regions = [{"region_id": 42, "name": "Washington, DC"}, {"region_id": "7", "name": "Elsewhere"}]
    path.write_text(json.dumps({"data": {"regions": regions}}))
    table = str(tmp_path / "t")
    ingest.ingest_regions(spark, str(path), table)
    got = by(read_table(spark, table, REGIONS), "region_id")
    assert (got[42]["code"], got[7]["code"]) == ("WDC", None)


def weather_day(folder, day, **record):
    folder.mkdir(exist_ok=True)
    midnight = dt.datetime.combine(day, dt.time(4))  # 00:00 in New York in October
    time = int(midnight.replace(tzinfo=dt.timezone.utc).timestamp())
    body = {"daily": {"summary": "s", "data": [{"time": time, **record}]}}
    (folder / f"{day}.json").write_text(json.dumps(body, indent=1))


def test_weather_fills_gaps_and_keeps_one_row_per_date(spark, tmp_path):
    drop = tmp_path / "w"
    weather_day(drop, D(2018, 10, 1), precipProbability=0.5, precipType="rain", ozone=300.1)
    weather_day(drop, D(2018, 10, 2), temperatureHighTime=1538506800, icon="fog", windGust=3.2)
    weather_day(drop, D(2018, 10, 3))
    table = str(tmp_path / "t")
    ingest.ingest_weather(spark, str(drop), table, D(2018, 10, 1), D(2018, 10, 2))
    stored = read_table(spark, table, WEATHER)
    assert stored.columns == WEATHER.names and len(stored.columns) == 36
    got = by(stored, "weather_date")
    assert set(got) == {D(2018, 10, 1), D(2018, 10, 2)}
    assert got[D(2018, 10, 1)]["preciptype"] == "rain"
    assert got[D(2018, 10, 2)]["preciptype"] == "0"
    assert got[D(2018, 10, 2)]["precipprobability"] == 0.0
    assert got[D(2018, 10, 2)]["temperaturehightime"] == 1538506800
    with pytest.raises(ValueError, match="weather_date"):
        ingest.ingest_weather(spark, str(drop), table, D(2018, 10, 2), D(2018, 10, 3))
    ingest.ingest_weather(spark, str(drop), table, D(2018, 10, 3), D(2018, 10, 3))
    assert read_table(spark, table, WEATHER).count() == 3


def test_delimited_round_trip_keeps_values(spark, tmp_path):
    df = trips(
        spark,
        trip("2018-09-05 00:00:01.000001", "2018-09-05 00:00:02", start_station='pipe | and "quote"'),
        trip("2018-09-05 00:00:01", bike=None, end_station=""),
    )
    ingest.bulk_copy(df, str(tmp_path / "out"), str(tmp_path / "t"))
    got = read_table(spark, str(tmp_path / "t"), TRIPS)
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    load_delimited(spark, str(tmp_path / "out"), str(tmp_path / "t"), TRIPS)
    assert read_table(spark, str(tmp_path / "t"), TRIPS).count() == 4


def test_delimited_text_is_kept_and_line_breaks_are_refused(spark, tmp_path):
    rows = [(i, x) for i, x in enumerate([*registry.AWKWARD, None, "\t", '""', "\\", "\\n", "|"])]
    df = spark.createDataFrame(rows, "i LONG, x STRING")
    for sep in "|,":
        out = str(tmp_path / f"out{ord(sep)}")
        export_csv(df, out, sep)
        assert sorted(read_delimited(spark, out, df.schema, sep).collect()) == rows
    for bad in ("a\nb", "a\rb"):
        with pytest.raises(Exception, match="line break in x"):
            export_csv(spark.createDataFrame([(1, bad)], df.schema), str(tmp_path / "bad"))


def test_delimited_values_must_fit(spark, tmp_path):
    export_csv(spark.createDataFrame([("x",)], "station_id STRING"), str(tmp_path / "x"), "|")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        schema = STATIONS.__class__([STATIONS["station_id"]])
        read_delimited(spark, str(tmp_path / "x"), schema).collect()


def test_commands_build_tables_and_write_a_report(spark, tmp_path):
    tables, out = str(tmp_path / "tables"), str(tmp_path / "report")
    write_drop(tmp_path / "d", "2018.csv", numbered(0, 20))
    jobs.run(spark, jobs._arguments(["append-trips", "--source", f"{tmp_path}/d", "--tables", tables]))
    jobs.run(
        spark,
        jobs._arguments(["report", "daily_fleet_trip_days", "--tables", tables, "--out", out]),
    )
    stored = jobs.TableFolder(spark, tables).trips()
    text = plan(within(stored, D(2018, 9, 5), D(2018, 10, 31)))
    assert re.search(r"PartitionFilters: \[[^\]]*start_month#\d+ >= 2018-09-01", text)
    row = spark.read.option("header", True).csv(out).first()
    assert (row["date"], row["classic_trips"], row["classic_fleet"]) == ("2018-09-05", "20", "20")
    with pytest.raises(SystemExit):
        jobs._arguments(["report", "total_vehicles", "--tables", tables, "--out", out])


def test_each_report_takes_the_bounds_it_uses(spark):
    base = ["--tables", "t", "--out", "o", "--provider", "p"]
    for name in REPORTS:
        for bound in ("first", "last"):
            argv = ["report", name, *base, f"--{bound}", "2018-09-05"]
            if bound == "last" and name not in jobs.CLOSED or name in jobs.UNBOUNDED:
                with pytest.raises(SystemExit):
                    jobs._arguments(argv)
                continue
            study = jobs._study(name, jobs._arguments(argv))
            used = f"{jobs._PERIOD.get(name, '')}{bound}"
            assert getattr(study, used) == D(2018, 9, 5)
            body = inspect.getsource(reports)
            assert f"s.{used}" in body
    assert jobs.CLOSED | jobs.UNBOUNDED <= set(REPORTS)


def test_a_trips_table_without_months_is_read_and_added_to(spark, tmp_path):
    table = str(tmp_path / "tables" / "trips")
    plain = trips(spark, trip("2018-09-05 08:00:00")).withColumn("trip_id", F.lit(7))
    append_table(plain, table, NUMBERED_TRIPS)
    write_drop(tmp_path / "d", "2018.csv", numbered(0, 2))
    ingest.append_trips(spark, str(tmp_path / "d"), table)
    stored = jobs.TableFolder(spark, str(tmp_path / "tables")).trips()
    assert "start_month" not in stored.columns
    assert sorted(r["trip_id"] for r in dicts(within(stored, D(2018, 9, 1)))) == [7, 8, 9]
    assert within(stored, D(2018, 9, 6)).count() == 0


def test_a_trips_table_by_month_gives_the_period(spark, tmp_path):
    table = str(tmp_path / "tables" / "trips")
    days = ["2018-08-31", "2018-09-01", "2018-09-30", "2018-10-01", "2018-10-02"]
    rows = [trip(f"{d} 23:59:59") for d in days]
    append_trips_table(trips(spark, *rows).withColumn("trip_id", F.lit(1)), table)
    stored = jobs.TableFolder(spark, str(tmp_path / "tables")).trips()
    got = within(stored, D(2018, 9, 1), D(2018, 10, 1))
    assert sorted(str(r["start_date"].date()) for r in dicts(got)) == days[1:4]
    assert within(stored, D(2018, 9, 30)).count() == 3


def test_commands_cover_the_other_tables(spark, tmp_path):
    tables = str(tmp_path / "tables")

    def job(*argv):
        jobs.run(spark, jobs._arguments([*argv, "--tables", tables]))

    header = ID_HEADER
    rows = [second_row("2018-08-21 00:00:00", b) for b in (1, 2)] + [second_row("2018-09-21 00:00:00", 3)]
    write_drop(tmp_path / "c", "2018-08.csv", rows, header)
    job("trips-by-year", "--source", f"{tmp_path}/c", "--years", "2018")
    job("ebikes")
    job("stations", "--source", snapshot(tmp_path, entry("a", "A", "1")))
    weather_day(tmp_path / "w", D(2018, 10, 1), precipProbability=0.5)
    job("weather", "--source", f"{tmp_path}/w")
    folder = jobs.TableFolder(spark, tables)
    assert sorted(r[0] for r in folder.ebikes().collect()) == ["1", "2"]
    assert folder.stations().count() == folder.weather().count() == 1
    job("report", "ebike_fleet_calendar", "--out", f"{tmp_path}/r", "--first", "2018-08-21")
    got = by(spark.read.option("header", True).csv(f"{tmp_path}/r"), "date")
    assert got["2018-08-21"]["ebike_trips"] == "2"
    assert min(got) == "2018-08-21" and max(got) == "2018-09-30"


def test_append_keeps_what_is_stored(spark, tmp_path):
    table = str(tmp_path / "t")
    for _ in range(2):
        append_table(trips(spark, trip("2018-09-05 08:00:00")), table, TRIPS)
    assert read_table(spark, table, TRIPS).count() == 2
