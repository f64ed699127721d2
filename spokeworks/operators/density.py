"""Gaussian kernel density curves from binned values."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 2048
BINS_PER_BANDWIDTH = 64
GRID_POINTS = 100
REACH = 3.0
# Bandwidths beyond which a kernel counts as nothing: it is below 2e-14 of its height there.
BAND = 8.0


def density_curves(
    values: DataFrame,
    group: list[str],
    value: str,
    upper: str,
    bins: int = BINS,
    points: int = GRID_POINTS,
    reach: float = REACH,
) -> DataFrame:
    """``group, point, x, density`` of ``value`` (in ``0..upper``) per group.

    For values that fill their range: one pass leaves a row per group and bin of
    ``upper / bins``, combined before the shuffle. See ``_curves``.
    """
    width = F.col(upper) / bins
    slot = F.least(F.floor(F.col(value) / width), F.lit(bins - 1))
    return _curves(_binned(values, group, value, F.lit(1), slot, width), group, points, reach)


def counted_density_curves(
    counted: DataFrame,
    group: list[str],
    value: str,
    times: str,
    points: int = GRID_POINTS,
    reach: float = REACH,
) -> DataFrame:
    """``group, point, x, density`` of values of any range that occur ``times`` each.

    Bins are a small part of the group's bandwidth wide, and only those with
    values are kept: a far value costs a bin of its own and no accuracy. The
    counted rows are read twice, for the bandwidth and for the bins.
    """
    there = counted.where(F.col(value).isNotNull())
    weight, v = F.col(times), F.col(value)
    moments = (
        there.groupBy(*group)
        .agg(F.sum(times).alias("_times"), F.sum(weight * v).alias("_sum"), F.sum(weight * v * v).alias("_sum2"))
        .withColumn("_squares", F.col("_sum2") - F.col("_sum") * F.col("_sum") / F.col("_times"))
        # enough for the width of bins; the curves take their bandwidth from the bins
        .select(*group, (_bandwidth("_squares", "_times") / BINS_PER_BANDWIDTH).alias("_width"))
        .where("_width > 0")
    )
    slot = F.floor(F.col(value) / F.col("_width"))
    sized = _of_group(there, moments, group)
    return _curves(_binned(sized, group, value, weight, slot, F.col("_width")), group, points, reach)


def _of_group(rows: DataFrame, groups: DataFrame, group: list[str]) -> DataFrame:
    """The rows with what is known of their group; groups may be NULL."""
    named = groups.withColumnsRenamed({g: f"_of_{g}" for g in group})
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in group])
    return rows.join(named, same).drop(*(f"_of_{g}" for g in group))


def _bandwidth(squares: str, n: str) -> Column:
    """Scott's rule: the sample deviation times ``n ** (-1/5)``; NULL for a single value."""
    return F.sqrt(F.try_divide(F.col(squares), F.col(n) - 1)) * F.pow(F.col(n), F.lit(-0.2))


def _binned(
    values: DataFrame, group: list[str], value: str, times: Column, slot: Column, width: Column
) -> DataFrame:
    """Of each group and bin: count, mean, squared deviation, smallest, largest."""
    centre = (F.col("_slot") + 0.5) * F.col("_width")
    return (
        values.where(F.col(value).isNotNull())
        .withColumns({"_width": width, "_slot": slot, "_times": times})
        .withColumn("_off", F.col(value) - centre)
        .groupBy(*group, "_slot", "_width")
        .agg(
            F.sum("_times").alias("_n"),
            F.sum(F.col("_times") * F.col("_off")).alias("_off"),
            F.sum(F.col("_times") * F.col("_off") * F.col("_off")).alias("_off2"),
            F.min(value).alias("_min"),
            F.max(value).alias("_max"),
        )
        .withColumn("_mean", centre + F.col("_off") / F.col("_n"))
        .withColumn("_spread", F.col("_off2") - F.col("_off") * F.col("_off") / F.col("_n"))
    )


def _curves(binned: DataFrame, group: list[str], points: int, reach: float) -> DataFrame:
    """The curves of binned values.

    The ``points`` grid points run from ``reach`` bandwidths below the smallest to
    ``reach`` above the largest value. A group without spread has no bandwidth
    and gives no curve. The group's mean and deviation, merged from its bins, are
    exact; a bin's kernels are those of its mean, corrected for the spread of the
    values within the bin.

    A bin meets the grid points within ``BAND`` bandwidths only. The first bin of a group
    meets all of them, so that a point far from every value has its row, near zero.
    """
    whole = Window.partitionBy(*group)
    total = F.sum("_n").over(whole)
    mean = F.sum(F.col("_n") * F.col("_mean")).over(whole) / total
    sized = (
        binned.withColumns({"_total": total, "_centre": mean})
        .withColumn("_gap", F.col("_mean") - F.col("_centre"))
        .withColumn(
            "_squares",
            F.sum(F.col("_spread") + F.col("_n") * F.col("_gap") * F.col("_gap")).over(whole),
        )
        .withColumn("_h", _bandwidth("_squares", "_total"))
        .where(F.col("_h") > 0)
        .withColumns(
            {
                "_from": F.min("_min").over(whole) - reach * F.col("_h"),
                "_to": F.max("_max").over(whole) + reach * F.col("_h"),
            }
        )
    )
    x = F.col("_from") + F.col("point") * (F.col("_to") - F.col("_from")) / (points - 1)
    step = (F.col("_to") - F.col("_from")) / (points - 1)
    near = BAND * F.col("_h")
    low = F.greatest(F.ceil((F.col("_mean") - near - F.col("_from")) / step), F.lit(0)).cast("int")
    high = F.least(F.floor((F.col("_mean") + near - F.col("_from")) / step), F.lit(points - 1)).cast("int")
    all_points = F.sequence(F.lit(0), F.lit(points - 1))
    met = F.when(F.col("_slot") == F.min("_slot").over(whole), all_points).when(low <= high, F.sequence(low, F.greatest(low, high)))
    z = (F.col("x") - F.col("_mean")) / F.col("_h")
    within = F.greatest("_spread", F.lit(0.0)) / (F.col("_h") * F.col("_h"))
    kernels = (F.col("_n") + (z * z - 1) / 2 * within) * F.exp(-z * z / 2)
    scale = F.col("_total") * F.col("_h") * math.sqrt(2 * math.pi)
    return (
        sized.withColumn("_met", met)
        .withColumn("point", F.explode("_met"))
        .withColumn("x", x)
        .groupBy(*group, "point", "x")
        .agg(F.sum(kernels / scale).alias("density"))
    )
