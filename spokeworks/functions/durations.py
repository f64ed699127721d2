"""Elapsed time, time of day and calendar parts.

Spans are exact whole microseconds. They come from interval arithmetic, so for
TIMESTAMP_NTZ input no session time zone takes part.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

US_PER_SECOND = 1_000_000
US_PER_MINUTE = 60 * US_PER_SECOND
US_PER_HOUR = 60 * US_PER_MINUTE


def _interval_us(interval: Column) -> Column:
    seconds = interval.cast("interval second").cast("decimal(18,6)")
    return (seconds * US_PER_SECOND).cast("bigint")


def elapsed_us(start: str = "start_date", end: str = "end_date") -> Column:
    """Microseconds from ``start`` to ``end``."""
    return _interval_us(F.col(end) - F.col(start))


def time_of_day_us(ts: str = "start_date") -> Column:
    """Microseconds since midnight."""
    return _interval_us(F.col(ts) - F.to_date(ts).cast("timestamp_ntz"))


def minutes(us: Column) -> Column:
    return us / US_PER_MINUTE


def hours(us: Column) -> Column:
    return us / US_PER_HOUR


def day_of_week(ts: str = "start_date") -> Column:
    """0 is Sunday."""
    return F.dayofweek(ts) - 1


def first_of_next_month(ts: Column) -> Column:
    return F.add_months(F.trunc(ts, "month"), 1)


def mean_seconds(us: Column) -> Column:
    """Aggregate: the mean of a microsecond column, in seconds.

    Whole seconds and the remainder are summed apart as BIGINT. The sums do not
    depend on row order, and a trillion trips stay far from an overflow that a
    plain BIGINT sum of microseconds would meet.
    """
    rest = F.pmod(us, F.lit(US_PER_SECOND))
    whole = ((us - rest) / US_PER_SECOND).cast("bigint")
    return F.try_divide(F.sum(whole) + F.sum(rest) / US_PER_SECOND, F.count(us))
