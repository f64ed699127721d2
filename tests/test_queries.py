"""Every registered query against its SQL, and the shape of the plans."""

from __future__ import annotations

import os
import re

import pytest
from helpers import plan

from checks import compare, oracle, registry
from spokeworks.reports import REPORTS

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
SMALL = "/root/testdata/sf0.001"
NAMES = sorted(registry.queries())

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return compare.oracle_connection(SF)


def test_every_query_has_sql():
    assert sorted(oracle.oracle_sql()) == NAMES


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    assert compare.difference(spark, con, SF, name) is None


@pytest.mark.parametrize("name", NAMES)
def test_plan_has_no_cross_join_and_no_python(spark, name):
    text = plan(registry.TYPED[name](spark, SMALL))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert node not in text


def test_single_partition_steps_only_see_calendar_rows(spark):
    """A window without a key may only follow an aggregate by day."""
    for name in NAMES:
        text = plan(registry.TYPED[name](spark, SMALL))
        for match in re.finditer(r"Exchange SinglePartition", text):
            below = text[match.end() :]
            assert "HashAggregate" in below.split("FileScan")[0], name


# These join two driver tables to make the second trip system.
JOINED = {"ebike_fleet_calendar", "first_seen_in_window"}


@pytest.mark.parametrize("name", sorted(set(REPORTS) - JOINED))
def test_only_combined_rows_are_shuffled(spark, name):
    """Between a scan and the first shuffle above it there is always an aggregate."""
    text = plan(registry.TYPED[name](spark, SMALL))
    for match in re.finditer(r"[^t]Exchange (hash|range|Single)", text):
        assert "Aggregate" in text[match.end() :].split("FileScan")[0], text


def test_date_filter_reaches_the_scan(spark):
    text = plan(registry.TYPED["avg_duration_by_date"](spark, SMALL))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts,", text)


def test_only_needed_columns_are_read(spark):
    text = plan(registry.TYPED["daily_fleet_calendar"](spark, SMALL))
    assert set(re.findall(r"ReadSchema: (struct<[^>]*>)", text)) == {
        "struct<ts:timestamp_ntz,user_id:bigint>"
    }


#: Reports that measure stations or hours before they join them to single trips.
MEASURING = {
    "trip_distance_speed",
    "avg_distance_speed_by_type",
    "daily_distance_speed",
    "density_curves",
    "trips_by_service_hours",
    "service_hours_share",
}


@pytest.mark.parametrize("name", sorted(set(REPORTS) - JOINED - MEASURING))
def test_building_a_report_runs_no_job(spark, name):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"build {name}", name)
    try:
        registry.TYPED[name](spark, SMALL)
        assert len(tracker.getJobIdsForGroup(f"build {name}")) == 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_one_scan_of_trips_for_the_running_share(spark):
    df = registry.TYPED["same_station_duration_cdf"](spark, SMALL)
    df.collect()
    final = plan(df).split("Initial Plan")[0]
    assert "ReusedExchange" in final
    assert final.count("FileScan") == 1


def test_one_scan_of_locations_for_vehicle_kinds(spark):
    text = plan(registry.TYPED["daily_vehicle_kinds"](spark, SMALL))
    assert text.count("FileScan") == 1
