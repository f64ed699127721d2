"""Bring frames to a table's shape, and check what the table promises."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spokeworks.operators.lookup import fits_broadcast


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema``: missing ones NULL, others dropped, cast, in order."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def fill_missing(df: DataFrame) -> DataFrame:
    """0 for a missing number and '0' for a missing text; dates stay missing."""

    def filled(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.StringType):
            return F.coalesce(F.col(f.name), F.lit("0")).alias(f.name)
        if isinstance(f.dataType, T.NumericType):
            return F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType)).alias(f.name)
        return F.col(f.name)

    return df.select(*[filled(f) for f in df.schema])


def key_violations(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that are missing or occur more than once, with their row count ``n``."""
    missing = F.lit(False)
    for k in key:
        missing = missing | F.col(k).isNull()
    return df.groupBy(*key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | missing)


def require_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """``df`` itself, or an error naming a few offending keys."""
    bad = key_violations(df, key).limit(5).collect()
    if bad:
        raise ValueError(f"{list(key)} is not a key: {[r.asDict() for r in bad]}")
    return df


def repeated_keys(new: DataFrame, stored: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys of ``new`` that are missing, that it has more than once, or that ``stored`` has.

    Only the new rows are grouped. The stored keys are read, but only compared: new keys that
    fit are broadcast, so stored rows aren't moved; else both sides are shuffled once, and
    adaptive execution may filter the stored ones by a Bloom filter of the new.
    """
    own = new.select(*key)
    within = key_violations(own, key).select(*key)
    distinct = own.distinct()
    probe = F.broadcast(distinct) if fits_broadcast(distinct) else distinct
    return within.unionByName(stored.select(*key).join(probe, list(key), "left_semi"))


def require_new_keys(new: DataFrame, stored: DataFrame, key: Sequence[str]) -> DataFrame:
    """``new`` itself, or an error naming a few keys that it or ``stored`` has already."""
    bad = repeated_keys(new, stored, key).limit(5).collect()
    if bad:
        raise ValueError(f"{list(key)} is not a key: {[r.asDict() for r in bad]}")
    return new
