"""Structured Streaming forms: comments, daily counts, de-duplication, windows, counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.wordlists import LABELS
from ..operators.monitoring import bucket_rows, histogram_columns
from ..plans.preprocess import preprocess
from ..session import shared_dir
from ..sources.files import names, remove


def read_stream(
    spark: SparkSession, folder: str, schema: T.StructType, files: str = "*.parquet", **options: str
) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.parquet(folder)


def comment_features(comments: DataFrame, **settings) -> DataFrame:
    """The stateless stage-one plan on a stream."""
    return preprocess(comments, **settings)


def features_to_table(
    comments: DataFrame, path: str, checkpoint: str, available_now: bool = True, **settings
) -> StreamingQuery:
    """Stage one of each batch, appended to a table; ``lemmas`` may be a table of any size.

    The table of lemmas is read anew by each batch.  A batch that is run again after a
    failure overwrites its own part, so each comment lands once.
    """

    def write(batch: DataFrame, number: int) -> None:
        preprocess(batch, **settings).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = comments.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def distinct_comments(comments: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each comment once, as long as its copies arrive within the delay."""
    return comments.withWatermark("created_utc", delay).dropDuplicatesWithinWatermark(["comment_id"])


def daily_label_counts(labelled: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Labels per day; a day is final once the watermark has passed its end.

    The state holds one row per open day.
    """
    day = F.window("created_utc", "1 day")
    counts = labelled.withWatermark("created_utc", delay).groupBy(day)
    return counts.agg(*[F.count_if(F.col("sentiment") == s).alias(s) for s in LABELS]).select(
        F.to_date("window.start").alias("day"), *LABELS
    )


def running_daily_counts(labelled: DataFrame) -> DataFrame:
    """Labels per day since the start, open days included; the state is one row per day."""
    day = F.to_date("created_utc").alias("day")
    return labelled.groupBy(day).agg(*[F.count_if(F.col("sentiment") == s).alias(s) for s in LABELS])


def running_counter(events: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Events per label combination since the start."""
    return events.groupBy(*labels).agg(F.count(F.lit(1)).alias("value"))


def running_histogram(events: DataFrame, labels: Sequence[str], value: str, bounds: Sequence[float]) -> DataFrame:
    """Histogram since the start, as rows of buckets; partial counts are merged per label."""
    counted = events.groupBy(*labels).agg(*histogram_columns(value, bounds))
    return counted.select(*labels, "sum", "count", bucket_rows(bounds))


def to_table(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream to a parquet table; each row lands once."""
    writer = stream.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def to_snapshots(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "complete", available_now: bool = True
) -> StreamingQuery:
    """Write each batch of a running aggregate as its own snapshot, of which the last two are kept.

    A batch that is run again after a failure overwrites its own snapshot only.
    """

    def write(batch: DataFrame, number: int) -> None:
        _refuse_lost_checkpoint(batch.sparkSession, path, number)
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        _keep_two(batch.sparkSession, path, number)

    writer = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the snapshots, by the names of their folders."""
    return sorted(int(n.removeprefix("batch=")) for n in names(spark, path) if n.startswith("batch="))


def _refuse_lost_checkpoint(spark: SparkSession, path: str, number: int) -> None:
    """A stream without its checkpoint starts at batch 0 again, beside a table that is further on."""
    newest = max(_batches(spark, path), default=number)
    if number < newest:
        raise RuntimeError(f"batch {number} would follow batch {newest} of {path}: the stream's checkpoint is lost")


def _keep_two(spark: SparkSession, path: str, number: int) -> None:
    for old in _batches(spark, path):
        if old < number - 1:
            remove(spark, f"{path}/batch={old}")


def newest_snapshot(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The table as the latest complete batch left it; before any batch it is empty, which needs the schema."""
    for number in reversed(_batches(spark, path)):
        if "_SUCCESS" in names(spark, f"{path}/batch={number}"):
            return (spark.read.schema(schema) if schema else spark.read).parquet(f"{path}/batch={number}")
    if schema is None:
        raise FileNotFoundError(f"no batch in {path}")
    return spark.createDataFrame([], schema)


def run_to_table(stream: DataFrame, purpose: str) -> DataFrame:
    """Run a stream over all available input and read the resulting table."""
    spark = stream.sparkSession
    base = shared_dir(spark, purpose)
    to_table(stream, f"{base}/rows", f"{base}/state").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
