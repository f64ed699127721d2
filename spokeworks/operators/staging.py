"""Written intermediate tables that outlive the executors that made them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_copies: ContextVar[list[str] | None] = ContextVar("copies", default=None)


def staging_root(spark: SparkSession) -> str:
    """The shared folder named by the session's ``spark.checkpoint.dir``.

    A local session without the setting gets a fresh temporary folder; a
    cluster session must name a shared one.
    """
    root = spark.conf.get(_SETTING, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder all executors share")
    return _local_root(spark.sparkContext.applicationId)


@cache
def _local_root(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"spokeworks-{application}-")


def staging_path(spark: SparkSession, label: str) -> str:
    """A folder name nobody else uses."""
    return f"{staging_root(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a scan of the written copy."""
    path = staging_path(df.sparkSession, label)
    if (copies := _copies.get()) is not None:
        copies.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing_copies(spark: SparkSession) -> Iterator[None]:
    """Copies staged inside are removed at the end; after an error they are kept.

    What is made of them must have been written by then.
    """
    copies: list[str] = []
    token = _copies.set(copies)
    try:
        yield
    finally:
        _copies.reset(token)
    for path in copies:
        remove_folder(spark, path)


def remove_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
