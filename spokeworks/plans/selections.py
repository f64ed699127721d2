"""Row selections shared by the analyses. All of them reach the Parquet scan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spokeworks.schemas import START_MONTH


def within(trips: DataFrame, first: dt.date, last: dt.date | None = None) -> DataFrame:
    """Trips that start on ``first`` or later, and on ``last`` or earlier.

    If the trips come with their month, by which the stored table is partitioned, only
    the folders of the period are read.
    """
    start, month = F.col("start_date"), F.col(START_MONTH)
    chosen = trips.where(start >= F.lit(first))
    if last is not None:
        chosen = chosen.where(start < F.lit(last + dt.timedelta(days=1)))
    if START_MONTH in trips.columns:
        chosen = chosen.where(month >= F.lit(first.replace(day=1)))
        if last is not None:
            chosen = chosen.where(month <= F.lit(last.replace(day=1)))
    return chosen


def forward() -> Column:
    """Trips that end after they start."""
    return F.col("end_date") > F.col("start_date")


def by_member_type(member_type: str) -> Column:
    return F.col("member_type") == member_type


def same_station() -> Column:
    return F.col("start_station") == F.col("end_station")
