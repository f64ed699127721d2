"""Left joins of a large table to a dimension that is usually, not always, small."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32


def fits_broadcast(
    dim: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Measure ``dim``: at most ``max_rows`` rows and ``max_bytes`` of values.

    One distributed aggregate; each task reports two numbers, however large
    the dimension turns out to be. Nested columns are not measured, so a dimension
    that has any does not pass.
    """
    width = F.lit(0).cast("bigint")
    for f in dim.schema:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            return False
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(f.name), F.lit(0)) + 16
        else:
            width = width + 16
    seen = dim.agg(F.count("*").alias("n"), F.sum(width).alias("b")).first()
    return seen["n"] <= max_rows and (seen["b"] or 0) <= max_bytes


def attach(
    facts: DataFrame,
    dim: DataFrame,
    keys: dict[str, str],
    residual: Column | None = None,
    *,
    small: bool | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """``facts LEFT JOIN dim`` on ``facts.k = dim.v`` for each pair in ``keys``.

    The columns of ``dim`` must be named apart from those of ``facts``; its key
    columns are kept. A ``small`` dimension is broadcast and the facts are not
    moved; unless the caller has measured it, it is measured here. Facts that are
    few themselves, because they were counted before, need neither: ``salts=1`` is a
    plain join of which Spark picks the kind.

    Otherwise the facts are spread over ``salts`` slices per key, against one copy
    of the dimension per slice, so that many tasks share one hot key. The
    slice comes from the row's own values: a task that runs again sends
    its rows to the same place. Equal rows stay together; should they be very
    many, adaptive execution splits their partition.
    """
    on = [F.col(k) == F.col(v) for k, v in keys.items()]
    if residual is not None:
        on.append(residual)
    if salts == 1:
        return facts.join(dim, reduce(Column.__and__, on), "left")
    if fits_broadcast(dim) if small is None else small:
        return facts.join(F.broadcast(dim), reduce(Column.__and__, on), "left")

    slice_of = F.pmod(F.xxhash64(*facts.columns), F.lit(salts)).cast("int")
    spread = facts.withColumn("_slice", slice_of)
    copies = dim.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on.append(F.col("_slice") == F.col("_copy"))
    return spread.join(copies, reduce(Column.__and__, on), "left").drop("_slice", "_copy")
