from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from helpers import by, dicts, plan
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spokeworks.operators import staging
from spokeworks.operators.activity import active_intervals, calendar, with_active_counts
from spokeworks.operators.conform import (
    conform,
    fill_missing,
    key_violations,
    lower_names,
    require_key,
)
from spokeworks.operators.density import counted_density_curves, density_curves
from spokeworks.operators.lookup import attach, fits_broadcast
from spokeworks.operators.ranking import running_share, top_n
from spokeworks.operators.reshape import stack_rows
from spokeworks.operators.staging import stage, staging_root
from spokeworks.schemas import STATIONS, WEATHER


def test_conform_adds_drops_casts_and_orders(spark):
    df = spark.createDataFrame([("7", 1.5, "x")], "STATION_ID STRING, lat DOUBLE, extra STRING")
    got = conform(lower_names(df), STATIONS)
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in STATIONS]
    row = got.first()
    assert (row["station_id"], row["lat"], row["name"]) == (7, 1.5, None)


def test_fill_missing_uses_zero_for_numbers_and_text(spark):
    row = fill_missing(conform(spark.range(1), WEATHER)).first()
    assert row["preciptype"] == "0"
    assert row["precipprobability"] == 0.0
    assert row["day_time"] == 0
    assert row["weather_date"] is None


def test_key_check(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k INT, v STRING")
    assert sorted((r["k"] or 0, r["n"]) for r in dicts(key_violations(df, ["k"]))) == [
        (0, 1),
        (1, 2),
    ]
    with pytest.raises(ValueError, match="not a key"):
        require_key(df, ["k"])
    assert require_key(df, ["v"]) is df


@pytest.mark.parametrize("small", [True, False, None])
def test_attach_is_a_left_join_on_either_path(spark, small):
    facts = spark.range(2_000).select(
        F.col("id"),
        F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 7 == 0, None).otherwise(
            F.concat(F.lit("k"), F.col("id") % 50)
        ).alias("k"),
        (F.col("id") % 20).alias("x"),
    )
    dim = spark.createDataFrame(
        [("hot", 0, 9, "low"), ("hot", 9, 15, "mid")] + [(f"k{i}", 0, 5, "any") for i in range(30)],
        "name STRING, lo INT, hi INT, label STRING",
    )
    inside = F.col("x").between(F.col("lo"), F.col("hi"))
    got = attach(facts, dim, {"k": "name"}, inside, small=small)
    want = facts.join(dim, (F.col("k") == F.col("name")) & inside, "left")
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    if small is False:
        assert "BroadcastNestedLoopJoin" not in plan(got)


def test_attach_spreads_a_hot_key(spark):
    facts = spark.range(3_200).select("id", F.lit("hot").alias("k"))
    dim = spark.createDataFrame([("hot", 1)], "name STRING, v INT")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = attach(facts, dim, {"k": "name"}, small=False)
        tasks = got.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(tasks) > 4
    assert sum(r["count"] for r in tasks) == 3_200


def test_fits_broadcast_checks_rows_and_bytes(spark):
    dim = spark.range(100).select(F.col("id"), F.repeat(F.lit("x"), 1000).alias("s"))
    assert fits_broadcast(dim)
    assert not fits_broadcast(dim, max_rows=99)
    assert not fits_broadcast(dim, max_bytes=100_000)
    assert fits_broadcast(dim.where("id < 0"))
    assert not fits_broadcast(dim.select("id", F.array("s").alias("nested")))


def test_calendar_has_both_ends(spark):
    days = [r["date"] for r in calendar(spark, dt.date(2018, 2, 27), dt.date(2018, 3, 1)).collect()]
    assert days == [dt.date(2018, 2, 27), dt.date(2018, 2, 28), dt.date(2018, 3, 1)]


def test_active_counts_equal_the_range_join(spark):
    rng = random.Random(7)
    base = dt.date(2018, 1, 1)
    rows = []
    for i in range(300):
        lo = base + dt.timedelta(days=rng.randrange(400))
        rows.append((i, lo, lo + dt.timedelta(days=rng.randrange(0, 60))))
    intervals = spark.createDataFrame(rows, "id INT, first_day DATE, last_day DATE")
    # days before, inside and after the intervals, with a gap
    days = [base + dt.timedelta(days=d) for d in (*range(-5, 90), *range(200, 480))]
    frame = spark.createDataFrame([(d, "kept") for d in days], "date DATE, tag STRING")
    odd = F.col("id") % 2 == 1
    got = by(with_active_counts(frame, intervals, {"odd": odd, "even": ~odd}), "date")
    assert set(got) == set(days)
    for d in days:
        inside = [i for i, lo, hi in rows if lo <= d <= hi]
        assert got[d]["odd"] == sum(i % 2 for i in inside)
        assert got[d]["even"] == sum(1 - i % 2 for i in inside)
        assert got[d]["tag"] == "kept"


def test_active_interval_ends_on_the_first_of_the_next_month(spark):
    rows = [
        ("W1", dt.datetime(2018, 9, 5, 23, 59)),
        ("W1", dt.datetime(2018, 9, 30, 23, 59, 59)),
        ("E1", dt.datetime(2018, 10, 1)),
        (None, dt.datetime(2018, 10, 1)),
    ]
    df = spark.createDataFrame(rows, "bike_number STRING, start_date TIMESTAMP_NTZ")
    got = by(active_intervals(df), "bike_number")
    assert set(got) == {"W1", "E1"}
    assert got["W1"]["first_day"] == dt.date(2018, 9, 5)
    assert got["W1"]["last_day"] == dt.date(2018, 10, 1)
    assert got["E1"]["last_day"] == dt.date(2018, 11, 1)


def test_top_n_limits_groups_before_the_shuffle(spark):
    df = spark.range(1_000).select((F.col("id") % 2).alias("g"), "id")
    got = top_n(df, ["g"], [F.desc("id")], 3)
    assert sorted(r["id"] for r in dicts(got)) == [994, 995, 996, 997, 998, 999]
    assert "WindowGroupLimit" in plan(got)


def test_running_share_equals_a_plain_running_sum(spark):
    rng = random.Random(3)
    rows = [
        (g, us, rng.randrange(1, 9))
        for g in ("a", "b")
        for us in rng.sample(range(20_000_000), 400)
    ]
    df = spark.createDataFrame(rows, "g STRING, us BIGINT, n BIGINT")
    bucket = F.floor(F.col("us") / 1_000_000)
    got = by(running_share(df, "g", "us", "n", bucket, "share"), "g", "us")
    assert len(got) == len(rows)
    for g in ("a", "b"):
        total = sum(n for k, _, n in rows if k == g)
        run = 0
        for _, us, n in sorted(r for r in rows if r[0] == g):
            run += n
            assert got[g, us]["share"] == pytest.approx(run / total, rel=1e-12)
        assert max(r["share"] for k, r in got.items() if k[0] == g) == 1.0


def test_stack_rows_keeps_missing_values(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, None, 4.0)], "id INT, a DOUBLE, b DOUBLE")
    got = stack_rows(
        df,
        ["id"],
        [{"k": F.lit("a"), "v": F.col("a")}, {"k": F.lit("b"), "v": F.col("b")}],
    )
    assert sorted((r["id"], r["k"], r["v"] or 0) for r in dicts(got)) == [
        (1, "a", 2.0),
        (1, "b", 0),
        (2, "a", 0),
        (2, "b", 4.0),
    ]


def test_density_is_close_to_a_kernel_per_value(spark):
    rng = random.Random(11)
    values = [min(max(rng.gauss(20, 6), 0.0), 60.0) for _ in range(800)]
    rows = [("m", "g", v, 60.0) for v in values] + [("m", "flat", 5.0, 60.0)] * 3
    df = spark.createDataFrame(rows, "measure STRING, kind STRING, v DOUBLE, upper DOUBLE")
    got = sorted(
        dicts(density_curves(df, ["measure", "kind"], "v", "upper")), key=lambda r: r["point"]
    )
    assert {r["kind"] for r in got} == {"g"}  # no spread, no curve
    assert len(got) == 100
    n = len(values)
    mean = sum(values) / n
    h = math.sqrt(sum((v - mean) ** 2 for v in values) / (n - 1)) * n**-0.2
    assert got[0]["x"] == pytest.approx(min(values) - 3 * h, rel=1e-9)
    assert got[-1]["x"] == pytest.approx(max(values) + 3 * h, rel=1e-9)
    for r in got:
        exact = sum(math.exp(-(((r["x"] - v) / h) ** 2) / 2) for v in values) / (
            n * h * math.sqrt(2 * math.pi)
        )
        assert r["density"] == pytest.approx(exact, abs=1e-5)
    step = got[1]["x"] - got[0]["x"]
    assert sum(r["density"] for r in got) * step == pytest.approx(1.0, abs=2e-3)


def test_one_far_value_leaves_the_density_right(spark):
    near = [3.0 * i / 1999 for i in range(2000)]
    rows = [("g", v, 1000) for v in near] + [("g", 6000.0, 1)]
    df = spark.createDataFrame(rows, "kind STRING, v DOUBLE, times LONG")
    got = dicts(counted_density_curves(df, ["kind"], "v", "times", points=4000))
    n = 2_000_001
    mean = sum(v * t for _, v, t in rows) / n
    h = math.sqrt(sum(t * (v - mean) ** 2 for _, v, t in rows) / (n - 1)) * n**-0.2
    inside = [r for r in got if 0 < r["x"] < 3]
    assert inside
    for r in inside:
        exact = sum(t * math.exp(-(((r["x"] - v) / h) ** 2) / 2) for _, v, t in rows) / (
            n * h * math.sqrt(2 * math.pi)
        )
        assert r["density"] == pytest.approx(exact, rel=1e-6)


def test_density_puts_the_upper_limit_in_the_last_bin(spark):
    rows = [("m", v, 5.0) for v in (0.0, 2.5, 5.0)]
    df = spark.createDataFrame(rows, "measure STRING, v DOUBLE, upper DOUBLE")
    got = dicts(density_curves(df, ["measure"], "v", "upper", bins=2, points=3))
    assert len(got) == 3
    assert all(r["density"] > 0 for r in got)


def test_staging_without_the_setting(spark, monkeypatch):
    assert staging_root(spark) == spark.conf.get("spark.checkpoint.dir")
    monkeypatch.setattr(staging, "_SETTING", "spark.not.set.anywhere")
    root = staging_root(spark)
    assert root == staging_root(spark) and "spokeworks-local-" in root
    assert stage(spark.range(3), "t").count() == 3

    class Cluster:
        master = "spark://elsewhere:7077"

    class Session:
        conf, sparkContext = spark.conf, Cluster

    with pytest.raises(ValueError, match="share"):
        staging_root(Session)


def test_stage_reads_back_what_it_wrote(spark):
    df = spark.range(10).withColumn("s", F.lit(None).cast("string"))
    staged = stage(df, "t")
    assert staged.inputFiles()[0].startswith(f"file:{staging_root(spark)}") or staging_root(
        spark
    ) in staged.inputFiles()[0]
    assert staged.count() == 10
    assert staged.schema["s"].dataType == T.StringType()
