"""Files and folders through Hadoop's file systems, from the driver and without a Spark job."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the sub-folders; none if there is no such folder."""
    fs, where = _at(spark, path)
    if not fs.exists(where):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory())


def files_below(spark: SparkSession, path: str, ending: str) -> list[tuple[str, int]]:
    """Path and length of the files in a folder and its sub-folders; no file is opened."""
    fs, where = _at(spark, path)
    found, listed = [], fs.listFiles(where, True)
    while listed.hasNext():
        status = listed.next()
        if status.getPath().getName().endswith(ending):
            found.append((status.getPath().toString(), status.getLen()))
    return sorted(found)


def first_line(spark: SparkSession, path: str) -> str | None:
    fs, where = _at(spark, path)
    stream = fs.open(where)
    jvm = spark._jvm.java.io
    try:
        return jvm.BufferedReader(jvm.InputStreamReader(stream, "UTF-8")).readLine()
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _at(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file that wasn't there; False if it was. Of several jobs one succeeds.

    A local file system is asked by itself, as Hadoop's way to it looks first and creates
    then, which two jobs can do at once.
    """
    fs, where = _at(spark, path)
    fs.mkdirs(where.getParent())
    raw = bytearray(text.encode())
    jvm = spark._jvm
    try:
        if fs.getUri().getScheme() == "file":
            options = spark.sparkContext._gateway.new_array(jvm.java.nio.file.OpenOption, 2)
            options[0] = jvm.java.nio.file.StandardOpenOption.CREATE_NEW
            options[1] = jvm.java.nio.file.StandardOpenOption.WRITE
            jvm.java.nio.file.Files.write(jvm.java.io.File(where.toUri().getPath()).toPath(), raw, options)
        else:
            stream = fs.create(where, False)
            stream.write(raw)
            stream.close()
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName() or fs.exists(where):
            return False
        raise
    return True


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file or folder; ``target`` must not be there."""
    fs, where = _at(spark, source)
    if not fs.rename(where, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"{source} could not be renamed to {target}")


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)
