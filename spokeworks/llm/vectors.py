"""Checks and block forms that the operators on vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not all zero, and without null or non-finite components."""
    infinite = float("inf")
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors(df: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, vec`` only, in double precision; other columns are left behind."""
    return df.select(
        F.col(f"`{id_}`").cast("bigint").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vec")
    )


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of equally long lists as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
