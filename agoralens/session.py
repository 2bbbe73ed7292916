"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession

# Results depend on the first two; the rest only on speed.
#   timeZone               all calendar fields are UTC
#   ansi                   overflow and bad casts raise instead of turning into nulls
#   windowGroupLimit...    lets "first n rows per key" drop rows before the shuffle for n up to 10,000
SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings every operator relies on to an existing session."""
    for key, value in SESSION_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(name: str = "agoralens", cores: str = "*", **settings: str) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        # Not sending the call site of every column expression makes plans quicker to build.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in {**SESSION_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="agoralens-")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path, visible to every executor, for tables and streaming state.

    It lies under ``spark.checkpoint.dir`` as the cluster names it.  Only a
    ``local`` master, where driver and executors are one process, may fall back
    to a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        # local-cluster has executors of its own.
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_folder()
    return f"{_own(spark, base)}/{purpose}-{uuid.uuid4().hex}"


def _own(spark: SparkSession, base: str) -> str:
    """The folder of this application; no other one writes there."""
    return f"{base.rstrip('/')}/agoralens-{spark.sparkContext.applicationId}"


def remove_intermediates(spark: SparkSession) -> None:
    """Remove what this application has written down; frames that read it can't be used any more."""
    from .sources.files import remove

    base = spark.conf.get("spark.checkpoint.dir", None) or _local_folder()
    remove(spark, _own(spark, base))


def materialize(df, purpose: str):
    """Write a frame to the shared folder and read it back.

    Used where several later steps read one intermediate result: the written
    table survives lost executors, unlike cached blocks.  Intermediate texts are read
    a few times at most, so they are packed tighter than by default.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
