"""Vehicle kinds kept up to date batch by batch, with retraction.

Whether a vehicle is a bike or a scooter is a matter of its whole history: a late tag, or
an earlier first sighting, changes days that were counted long ago. A batch of
locations is therefore reduced to its vehicles. What was known of these, and of no
others, is read; days of vehicles whose kind has changed are taken back and counted again;
days on which a vehicle wasn't seen before are added. The result is a table of
signed counts by day, whose sum is the report.

Three aggregates are kept for each batch: ``days`` (vehicles by day, distinct), ``flags``
(kinds and bounds of a vehicle's life, merged by or, minimum and maximum), both in hash
buckets of the vehicle, and ``counts`` (signed). The last one is written last: a batch
counts once it is there.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spokeworks.functions.durations import elapsed_us, mean_seconds
from spokeworks.operators.staging import passing_copies, stage
from spokeworks.plans.vehicles import tagged, with_kind
from spokeworks.schemas import KIND_COUNTS, VEHICLE_DAYS, VEHICLE_FLAGS
from spokeworks.sources import kept

BUCKETS = 64
BATCH = "batch"
_VEHICLE = ("provider", "bike_id")
_LAST = "counts"


def _bucket() -> Column:
    return F.pmod(F.xxhash64("bike_id"), F.lit(BUCKETS)).cast("int")


def _same(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = _VEHICLE) -> Column:
    """Equal keys; nulls are equal, as a location without a vehicle still has a day."""
    return reduce(Column.__and__, (a[k].eqNullSafe(b[k]) for k in keys))


def _shuffled(rows: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast.

    By the size of its files Spark takes a batch's vehicles, and their days, for small when in
    memory, and on their way through the driver, they are thirty times that.
    """
    return rows.hint("merge")


def batch_days(locations: DataFrame) -> DataFrame:
    """A batch's vehicles by day, with the tags and the bounds of the day."""
    return (
        with_kind(locations)
        .groupBy(*_VEHICLE, F.to_date("created").alias("date"))
        .agg(
            F.bool_or(tagged("bike")).alias("bike"),
            F.bool_or(tagged("scooter")).alias("scooter"),
            F.min("created").alias("first_seen"),
            F.max("created").alias("last_seen"),
        )
        .withColumn("bucket", _bucket())
    )


def merged_flags(rows: DataFrame, day: str) -> DataFrame:
    """A row for each vehicle; ``day`` is the column of its first days."""
    return rows.groupBy(*_VEHICLE).agg(
        F.bool_or("bike").alias("bike"),
        F.bool_or("scooter").alias("scooter"),
        F.min(day).alias("first_day"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


def _is_bike(tag: Column, first_day: Column, bikes_before: dt.date) -> Column:
    return tag | F.coalesce(first_day < F.lit(bikes_before), F.lit(False))


def step(fresh: DataFrame, flags: DataFrame, days: DataFrame, bikes_before: dt.date) -> tuple[DataFrame, DataFrame]:
    """``KIND_COUNTS`` that a batch adds, and the vehicle days that are new.

    ``fresh`` is ``batch_days``; ``flags`` and ``days`` are what earlier batches have kept
    of the same buckets. Both are cut down to the batch's vehicles before anything
    else, so the rest of the work goes with the batch and not with the history.
    """
    new = merged_flags(fresh, "date")
    touched = _shuffled(new.select(*_VEHICLE))
    old = merged_flags(flags.join(touched, _same(flags, touched), "left_semi"), "first_day").select(
        F.col("provider").alias("p"),
        F.col("bike_id").alias("b"),
        F.lit(True).alias("known"),
        _is_bike(F.col("bike"), F.col("first_day"), bikes_before).alias("was_bike"),
        F.col("scooter").alias("was_scooter"),
        F.col("first_day").alias("was_first"),
    )
    old = _shuffled(old)
    met = new.join(old, new["provider"].eqNullSafe(old["p"]) & new["bike_id"].eqNullSafe(old["b"]), "left")
    first = F.least("first_day", "was_first")  # skips nulls
    now = met.select(
        *_VEHICLE,
        "known",
        "was_bike",
        "was_scooter",
        (F.coalesce("was_bike", F.lit(False)) | _is_bike(F.col("bike"), first, bikes_before)).alias("is_bike"),
        (F.coalesce("was_scooter", F.lit(False)) | F.col("scooter")).alias("is_scooter"),
    )
    seen = days.join(touched, _same(days, touched), "left_semi").select(*_VEHICLE, "date")
    changed = now.where("known AND (is_bike <> was_bike OR is_scooter <> was_scooter)")
    again = seen.join(_shuffled(changed), _same(seen, changed)).select(
        seen["provider"],
        "date",
        (F.col("is_bike").cast("int") - F.col("was_bike").cast("int")).alias("bikes"),
        (F.col("is_scooter").cast("int") - F.col("was_scooter").cast("int")).alias("scooters"),
        F.lit(0).alias("vehicles"),
        seen["bike_id"],
    )
    own = fresh.select(*_VEHICLE, "date", "bucket")
    added = own.join(_shuffled(seen), _same(own, seen, (*_VEHICLE, "date")), "left_anti")
    counted = added.join(_shuffled(now), _same(added, now)).select(
        added["provider"],
        "date",
        F.col("is_bike").cast("int").alias("bikes"),
        F.col("is_scooter").cast("int").alias("scooters"),
        F.lit(1).alias("vehicles"),
        added["bike_id"],
    )
    known = F.col("bike_id").isNotNull()  # a day of locations without a vehicle has zeros
    counts = (
        again.unionByName(counted)
        .groupBy("provider", "date")
        .agg(*(F.sum(F.when(known, F.col(c)).otherwise(0)).alias(c) for c in ("bikes", "scooters", "vehicles")))
    )
    return counts, added


@dataclass(frozen=True)
class VehicleHistory:
    """What is kept of all batches of locations, for one date before which vehicles are bikes."""

    spark: SparkSession
    path: str
    bikes_before: dt.date

    def _path(self, part: str) -> str:
        return f"{self.path.rstrip('/')}/before_{self.bikes_before}/{part}"

    def batches(self) -> list[str]:
        return kept.finished(self.spark, self._path(_LAST), BATCH)

    def _read(self, part: str, schema, without: str | None = None) -> DataFrame:
        names = [b for b in self.batches() if b != without]
        return kept.read_parts(self.spark, self._path(part), schema, BATCH, names)

    def add(self, locations: DataFrame, batch: str) -> None:
        """Add a batch. One that is there already is left as it is; after a job that died it is made anew."""
        if batch in self.batches():
            return
        with passing_copies(self.spark):
            fresh = stage(batch_days(locations), "vehicle-days")
            # never more than BUCKETS numbers: only their folders are read
            buckets = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]
            own = F.col("bucket").isin(buckets)
            flags = self._read("flags", VEHICLE_FLAGS, batch).where(own)
            days = self._read("days", VEHICLE_DAYS, batch).where(own)
            counts, added = step(fresh, flags, days, self.bikes_before)
            kept.put(added, self._path("days"), BATCH, batch, "bucket")
            own_flags = merged_flags(fresh, "date").withColumn("bucket", _bucket())
            kept.put(own_flags, self._path("flags"), BATCH, batch, "bucket")
            kept.put(counts, self._path("counts"), BATCH, batch)

    def flags(self) -> DataFrame:
        return merged_flags(self._read("flags", VEHICLE_FLAGS), "first_day")

    def daily_kinds(self, provider: str) -> DataFrame:
        """What ``vehicles.daily_vehicle_kinds`` has: the sum of a row per day and batch."""
        counts = (
            self._read("counts", KIND_COUNTS)
            .where(F.col("provider") == provider)
            .groupBy("date")
            .agg(*(F.sum(c).alias(c) for c in ("bikes", "scooters", "vehicles")))
        )
        unknown = F.col("vehicles") - F.col("bikes") - F.col("scooters")
        return counts.withColumn("unknown", unknown).orderBy(F.asc_nulls_last("date"))

    def total_scooters(self) -> DataFrame:
        """One row: vehicles of any provider ever tagged as scooter."""
        return self.flags().where("scooter").agg(F.countDistinct("bike_id").alias("scooters"))

    def total_vehicles(self, provider: str) -> DataFrame:
        """One row: vehicles of one provider."""
        own = self.flags().where(F.col("provider") == provider)
        return own.agg(F.count("bike_id").alias("vehicles"))

    def avg_vehicle_age(self, provider: str, first_seen_by: dt.datetime) -> DataFrame:
        """What ``vehicles.avg_vehicle_age`` has, from a row per provider and vehicle."""
        seen = F.col("provider") == provider
        limit = F.lit(first_seen_by.isoformat(sep=" ")).cast("timestamp_ntz")
        return (
            self._read("flags", VEHICLE_FLAGS)
            .where("bike_id IS NOT NULL")
            .groupBy("bike_id")
            .agg(
                F.min(F.when(seen, F.col("first_seen"))).alias("first_seen"),
                F.max(F.when(seen, F.col("last_seen"))).alias("last_seen"),
                F.bool_or("scooter").alias("scooter"),
            )
            .where(F.col("scooter") & (F.col("first_seen") <= limit))
            .agg((mean_seconds(elapsed_us("first_seen", "last_seen")) / 86_400).alias("avg_days"))
        )
