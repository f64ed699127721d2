"""Run every query and its SQL on the same tables and compare the rows.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from checks import oracle, registry
from spokeworks.session import session

LOCAL = {
    "spark.master": "local[8]",
    "spark.ui.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    """As text for a fraction, which tells -0.0 from 0.0."""
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    return v


def rows_by_name(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(spark: SparkSession, con, sf_dir: str, name: str) -> str | None:
    """None if both engines give the same rows, else what differs."""
    df = registry.queries()[name](spark, sf_dir)
    ours = rows_by_name(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(oracle.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    if os.environ.get("SHOW_TYPES"):
        theirs_types = {d[0]: str(d[1]) for d in cursor.description}
        print({c: (t, theirs_types.get(c)) for c, t in df.dtypes})
    theirs = rows_by_name(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    if ours != theirs:
        return (
            f"{sum(ours.values())} vs {sum(theirs.values())} rows; only ours "
            f"{list((ours - theirs).items())[:3]}; only theirs {list((theirs - ours).items())[:3]}"
        )
    if not ours:
        return "no rows"
    return None


def main(sf_dir: str = "/root/testdata/sf0.01", *only: str) -> int:
    spark = session("compare", LOCAL)
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf_dir)
    failed = 0
    for name in only or registry.queries():
        t = time.time()
        try:
            found = difference(spark, con, sf_dir, name)
        except Exception as e:  # report and go on with the next query
            found = f"{type(e).__name__}: {str(e)[:600]}"
        failed += found is not None
        state = "FAIL" if found else "ok  "
        print(f"{state} {name} {time.time() - t:.2f}s {found or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
