"""Names of folders in any store that Spark can reach, and their removal."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds, in order; a folder that does not exist holds nothing."""
    store, where = _at(spark, path)
    return sorted(f.getPath().getName() for f in store.listStatus(where)) if store.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    store, where = _at(spark, path)
    store.delete(where, True)


def mark(spark: SparkSession, path: str) -> bool:
    """Create an empty file unless it is there; whether this call has created it."""
    store, where = _at(spark, path)
    store.mkdirs(where.getParent())
    return bool(store.createNewFile(where))
