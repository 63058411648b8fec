"""Lineage cuts in the folder that the cluster shares, and the end of what they leave behind."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder. Where it names none, a folder below
    the warehouse, which a cluster shares as well, or for a local master a temporary one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="corpusgraph-") if context.master.startswith("local") else f"{spark.conf.get('spark.sql.warehouse.dir')}/_corpusgraph"
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, kind: str) -> str:
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df, written as a table to the shared folder and read again, so later plans start from its true size.

    (checkpoint() keeps the size estimate of the plan behind it; over rounds of joins that number's digits double.)"""
    spark = df.sparkSession
    path = shared_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hinted(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df, to be broadcast if it has at most that many rows, and left to a shuffle join otherwise."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of tables that are no longer in use. Else they stay until the driver happens to collect
    its garbage, which it does no more often over large tables than over small ones."""
    gc.collect()  # Python's handles of the tables, which hold those of the JVM
    spark.sparkContext._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all tables made inside it, so a result has to be written before. Results of operators are lazy:
    whoever writes them says when their tables may go."""
    before = len(_made)
    try:
        yield
    finally:
        for path in _made[before:]:
            delete(spark, path)
        del _made[before:]
