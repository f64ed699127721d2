"""Session settings the jobs are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution sizes the shuffles at run time: many small partitions at first,
# merged to the advised size, and split again where a join side is skewed.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
}

# First number of shuffle partitions, before merging: so many for each core seen at the
# start, and no fewer than the least, as executors may register later.
PARTITIONS_PER_CORE = 4
LEAST_PARTITIONS = 400


def session(app: str, extra: dict[str, str] | None = None) -> SparkSession:
    """A session with ``extra`` settings, and ``SETTINGS`` where the submitter set none."""
    builder = SparkSession.builder.appName(app)
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    given = spark.sparkContext.getConf()
    for key, value in SETTINGS.items():
        if not given.contains(key):
            spark.conf.set(key, value)
    if not given.contains("spark.sql.shuffle.partitions"):
        cores = spark.sparkContext.defaultParallelism
        first = max(LEAST_PARTITIONS, cores * PARTITIONS_PER_CORE)
        spark.conf.set("spark.sql.shuffle.partitions", str(first))
    return spark
