from __future__ import annotations

from spokeworks import session as own


def test_first_partitions_do_not_follow_few_cores(spark, monkeypatch):
    """With few cores at the start there are many partitions all the same, to be merged."""
    before = spark.conf.get("spark.sql.shuffle.partitions")

    class Conf:
        def contains(self, key):
            return key != "spark.sql.shuffle.partitions"

    try:
        monkeypatch.setattr(type(spark.sparkContext), "getConf", lambda self: Conf())
        monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", 2)
        own.session("few cores")
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) >= 200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
