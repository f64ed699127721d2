"""Stored tables (Parquet folders) and delimited text exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spokeworks.operators.conform import conform, require_key
from spokeworks.schemas import NUMBERED_TRIPS, START_MONTH, STORED_TRIPS
from spokeworks.sources import drops, files


def _beside(path: str, what: str) -> str:
    return f"{path.rstrip('/')}__{what}"


def _pending(spark: SparkSession, path: str) -> list[str]:
    """Folders of partitions that count as replaced, though their new rows still lie beside the table."""
    if not files.exists(spark, _beside(path, "switch")):
        return []
    names = files.read_text(spark, _beside(path, "switch")).split("\n")
    return [n for n in names if files.exists(spark, f"{_beside(path, 'next')}/{n}")]


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table as it is, or None if nothing was stored yet.

    Should a replacement have broken off between its two renames, that is the old
    table; between the renames of partitions, the new partitions with the old others.
    """
    if not files.exists(spark, path) and files.exists(spark, _beside(path, "before")):
        path = _beside(path, "before")
    try:
        if pending := _pending(spark, path):
            by = pending[0].partition("=")[0]
            new = spark.read.parquet(_beside(path, "next")).where(_named(by, pending))
            old = spark.read.parquet(path).where(~_named(by, pending))
            return old.unionByName(new)
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            raise ValueError(f"{path} is a folder without a table: its first write broke off") from e
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, may_lack: Sequence[str] = ()
) -> DataFrame:
    """The stored table in the columns of ``schema``, or an empty one.

    A stored table without one of the columns is an error, but for those it
    ``may_lack``, which are NULL then.
    """
    stored = _stored(spark, path)
    if stored is None:
        return spark.createDataFrame([], schema)
    absent = set(schema.names) - set(stored.columns) - set(may_lack)
    if absent:
        raise ValueError(f"{path} has no columns {sorted(absent)}")
    return conform(stored, schema)


def append_table(
    df: DataFrame, path: str, schema: T.StructType, by: Sequence[str] = ()
) -> None:
    """Create the table if it is absent, then add rows, in folders of ``by`` if given."""
    conform(df, schema).write.mode("append").partitionBy(*by).parquet(path)


def read_trips_table(spark: SparkSession, path: str) -> DataFrame:
    """The stored trips; with the month they start in, if they are stored by it."""
    stored = _stored(spark, path)
    plain = stored is None or START_MONTH not in stored.columns
    return read_table(spark, path, NUMBERED_TRIPS if plain else STORED_TRIPS)


def append_trips_table(df: DataFrame, path: str) -> None:
    """Add numbered trips, stored by the month they start in.

    A table that is there already and not stored so is left as it is.
    """
    stored = _stored(df.sparkSession, path)
    if stored is not None and START_MONTH not in stored.columns:
        append_table(df, path, NUMBERED_TRIPS)
    else:
        month = F.trunc("start_date", "month")
        append_table(df.withColumn(START_MONTH, month), path, STORED_TRIPS, [START_MONTH])


def replace_table(
    df: DataFrame, path: str, schema: T.StructType, key: Sequence[str] = ()
) -> None:
    """Drop and recreate, if the rows have the promised ``key``.

    The rows are written beside the table, which ``df`` may read itself, and take its
    place by renaming. Whenever a job dies, the table is the old or the new one as a whole.
    """
    spark, beside = df.sparkSession, _beside(path, "next")
    with drops.claimed(spark, path):
        conform(df, schema).write.mode("overwrite").parquet(beside)
        if key:
            require_key(spark.read.schema(schema).parquet(beside), key)
        _switch(spark, path)


def _switch(spark: SparkSession, path: str) -> None:
    """Put what lies beside the table in its place. Until then the old one is kept beside it."""
    before = _beside(path, "before")
    if files.exists(spark, path):
        files.remove(spark, before)
        files.move(spark, path.rstrip("/"), before)
    files.move(spark, _beside(path, "next"), path.rstrip("/"))
    files.remove(spark, before)


def replace_partitions(df: DataFrame, path: str, schema: T.StructType, by: str, apart: bool = False) -> None:
    """Write the values of ``by`` that occur in ``df``; a rerun replaces them.

    Rows are brought together by ``by`` first, and large values split again, so the
    number of files follows the size of the data and not that of the tasks. Where each
    task has rows of one value only, and enough of them (``apart``), they stay where they are.

    All partitions are written beside the table. Then one small file names them: from
    that moment readers take all of them from there, and no earlier any. What is left is to
    rename each, which the next job does if this one dies.
    """
    spark, beside = df.sparkSession, _beside(path, "next")
    shaped = T.StructType([*schema.fields, df.schema[by]])
    rows = conform(df, shaped)
    with drops.claimed(spark, path):
        finish_switch(spark, path)
        (
            (rows if apart else rows.hint("rebalance", F.col(by)))
            .write.mode("overwrite")
            .partitionBy(by)
            .parquet(beside)
        )
        names = files.folder_names(spark, beside)
        if not files.exists(spark, path):
            files.move(spark, beside, path.rstrip("/"))
        elif names:
            files.create_once(spark, _beside(path, "switch"), "\n".join(names))
            finish_switch(spark, path)


def finish_switch(spark: SparkSession, path: str) -> None:
    """Rename the partitions that a job has named but not moved."""
    for name in _pending(spark, path):
        files.remove(spark, f"{path.rstrip('/')}/{name}")
        files.move(spark, f"{_beside(path, 'next')}/{name}", f"{path.rstrip('/')}/{name}")
    if files.exists(spark, _beside(path, "switch")):
        files.remove(spark, _beside(path, "switch"))
        files.remove(spark, _beside(path, "next"))


def _named(by: str, folders: Sequence[str]) -> Column:
    """Rows whose partition has one of these folders."""
    none = "__HIVE_DEFAULT_PARTITION__"
    values = [f.partition("=")[2] for f in folders]
    known = F.col(by).cast("string").isin([v for v in values if v != none])
    return F.coalesce(known, F.lit(none in values))


def last_id(table: DataFrame, column: str) -> int:
    """The largest stored id; 0 for an empty table."""
    return table.agg(F.coalesce(F.max(column), F.lit(0)).alias("id")).first()["id"]


def largest_stored(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One row ``id``: the largest value of a stored table's column, or NULL.

    Taken from the footers of its files, of which no row is read. The aggregate is
    pushed down by the newer reader only, which a session of its own is set to use.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return session.read.parquet(path).agg(F.max(column).alias("id"))


def stored_last_id(spark: SparkSession, path: str, schema: T.StructType, column: str) -> int:
    """The largest id of a stored table; 0 if there are no rows. A table without ``schema``'s
    columns is an error."""
    if not read_table(spark, path, schema).columns or not files.exists(spark, path):
        return 0
    return largest_stored(spark, path, column).first()["id"] or 0


def export_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Delimited text with a header; an existing export is replaced.

    Dates and timestamps are written in full, in the form a cast reads back. Blanks,
    separators and quotes are kept. A line break in a value is an error: files whose
    records span lines could not be split among tasks.
    """

    def plain(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DatetimeType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.StringType):
            broken = F.raise_error(F.lit(f"line break in {f.name}, which a delimited export can't hold"))
            c = F.when(c.rlike("[\\r\\n]"), broken).otherwise(c)
        return c.alias(f.name)

    (
        df.select(*[plain(f) for f in df.schema])
        .write.mode("overwrite")
        .options(header=True, sep=sep, escape='"', **_KEEP_BLANKS)
        .csv(path)
    )


_KEEP_BLANKS = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_delimited(
    spark: SparkSession, path: str, schema: T.StructType, sep: str = "|"
) -> DataFrame:
    """A delimited export with a header, in the target table's types.

    The header must name the table's columns; a value that does not fit its type is an
    error. A bare gap is NULL, ``""`` is an empty text: bikes without a number and bikes
    with an empty one are different things.
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    scan = (
        spark.read.schema(text)
        .options(header=True, enforceSchema=False, mode="FAILFAST", columnPruning=False)
        # no value holds a line break, so none is taken for NULL: only a bare gap is
        .options(sep=sep, escape='"', nullValue="\n", **_KEEP_BLANKS)
        .csv(path)
    )
    return conform(scan, schema)


def load_delimited(
    spark: SparkSession, path: str, table: str, schema: T.StructType, sep: str = "|"
) -> None:
    """Append a delimited export to a stored table."""
    append_table(read_delimited(spark, path, schema, sep), table, schema)
