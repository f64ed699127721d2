"""Aggregates kept beside a table, in one folder for each part of it.

A part is written by one job and counts once its ``_SUCCESS`` is there. What a job that
died has left doesn't count; it is written anew. Parts are merged by their readers, with
the aggregate that made them, so a part is never changed, only replaced as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from spokeworks.operators.staging import remove_folder
from spokeworks.sources import files


def finished(spark: SparkSession, path: str, key: str) -> list[str]:
    """Values of ``key`` whose folder ``path/key=value`` was written to its end."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{key}=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(s.getPath().getParent().getName().partition("=")[2] for s in found or [])


def put(df: DataFrame, path: str, key: str, value: str, *by: str) -> None:
    """Write the part ``key=value``, in folders of ``by``; written again it is replaced."""
    shaped = df.repartition(*by) if by else df
    shaped.write.mode("overwrite").partitionBy(*by).parquet(f"{path.rstrip('/')}/{key}={value}")


def mark(spark: SparkSession, path: str, key: str, value: str) -> None:
    """Let a part count that one job has written along with others; a part without rows has no folder."""
    folder = f"{path.rstrip('/')}/{key}={value}"
    if files.exists(spark, folder):
        files.create_once(spark, f"{folder}/_SUCCESS", "")


def read_parts(
    spark: SparkSession, path: str, schema: T.StructType, key: str, values: list[str]
) -> DataFrame:
    """The rows of these parts in the columns of ``schema``, not merged."""
    if not values:
        return spark.createDataFrame([], schema)
    root = path.rstrip("/")
    folders = [f"{root}/{key}={v}" for v in values]
    return spark.read.schema(schema).option("basePath", root).parquet(*folders).select(*schema.names)


SPAN = "span"
_BETWEEN = "_to_"


def span(after: int | None, upto: int) -> str:
    """The name of the part that holds ids above ``after`` (None: from the first) up to ``upto``."""
    return f"{'first' if after is None else after}{_BETWEEN}{upto}"


def spans(spark: SparkSession, path: str) -> tuple[list[str], int | None]:
    """Parts that follow each other from the first id on, and the last id they cover.

    Of parts that begin alike the longest counts: a merged one replaces those it was made of.
    """
    longest: dict[str, int] = {}
    for name in finished(spark, path, SPAN):
        after, _, upto = name.partition(_BETWEEN)
        longest[after] = max(int(upto), longest.get(after, int(upto)))
    chain: list[str] = []
    at: int | None = None
    while (after := "first" if at is None else str(at)) in longest:
        chain.append(span(at, longest[after]))
        at = longest[after]
    return chain, at


def drop_parts(spark: SparkSession, path: str, key: str, values: list[str]) -> None:
    for v in values:
        remove_folder(spark, f"{path.rstrip('/')}/{key}={v}")
