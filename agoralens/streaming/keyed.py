"""Tables that a stream renews by key: each batch writes only the keys that it has changed.

A batch is a folder ``batch=k`` of rows; the rows that the newest batch has of a key replace
all older ones.  Once the batches since the last base have as many rows as the base, they
are merged into a new one, so that a row is written again a number of times that grows
with the logarithm of the table, and the work of a batch follows the batch.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.monitoring import latest
from ..operators.ranking import join_null_safe
from ..sources.files import names, remove

BATCH = "_batch"
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_EARLIEST = -(2**63)


def to_keyed_table(
    stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], available_now: bool = True
) -> StreamingQuery:
    """Write the rows that each batch of a running aggregate or a stateful operator changes.

    ``keys`` say which rows are replaced together.  A batch that is run again after a
    failure overwrites its own folder, so the table is the same.
    """
    sizes: dict[str, int] = {}

    def rows_in(spark: SparkSession, folder: str) -> int:
        if folder not in sizes:
            sizes[folder] = spark.read.parquet(f"{path}/{folder}").count()
        return sizes[folder]

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        base, batches = _folders(spark, path, number - 1)
        newest = max([_number(f) for f in names(spark, path) if "=" in f], default=number)
        if newest > number:
            raise RuntimeError(f"batch {number} would follow batch {newest} of {path}: the stream's checkpoint is lost")
        batch.withColumn(BATCH, F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")
        sizes.pop(f"batch={number}", None)
        batches.append(f"batch={number}")
        held, since = (base, batches) if base else (batches[0], batches[1:])
        if since and sum(rows_in(spark, f) for f in since) >= rows_in(spark, held):
            _newest(spark, path, keys, base, batches, batch.schema).write.mode("overwrite").parquet(f"{path}/base={number}")
            sizes.pop(f"base={number}", None)
            # A reader may still be at the last base and its batches; what is older goes.
            before = _number(base) if base else -1
            for folder in names(spark, path):
                if "=" in folder and (_number(folder) < before or folder == f"batch={before}"):
                    remove(spark, f"{path}/{folder}")

    writer = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def newest_rows(spark: SparkSession, path: str, keys: Sequence[str], schema: T.StructType) -> DataFrame:
    """The table as the latest complete batch left it; before any batch it is empty."""
    base, batches = _folders(spark, path)
    if not base and not batches:
        return spark.createDataFrame([], schema)
    return _newest(spark, path, keys, base, batches, schema).drop(BATCH)


def _number(folder: str) -> int:
    return int(folder.split("=")[1])


def _folders(spark: SparkSession, path: str, upto: int | None = None) -> tuple[str | None, list[str]]:
    """The last complete base, if any, and the complete batches since, of those up to a number."""
    found = [f for f in names(spark, path) if "=" in f and (upto is None or _number(f) <= upto)]
    complete = [f for f in found if "_SUCCESS" in names(spark, f"{path}/{f}")]
    base = max((f for f in complete if f.startswith("base=")), key=_number, default=None)
    since = _number(base) if base else -1
    return base, sorted((f for f in complete if f.startswith("batch=") and _number(f) > since), key=_number)


def _newest(
    spark: SparkSession, path: str, keys: Sequence[str], base: str | None, batches: Sequence[str], schema: T.StructType
) -> DataFrame:
    own = T.StructType([*(f for f in schema.fields if f.name != BATCH), T.StructField(BATCH, T.IntegerType())])
    rows = spark.read.schema(own).parquet(*[f"{path}/{f}" for f in ([base] if base else []) + list(batches)])
    last = rows.groupBy(*keys).agg(F.max(BATCH).alias("_last"))
    return join_null_safe(rows, last, list(keys)).filter(F.col(BATCH) == F.col("_last")).drop("_last")


def last_n_per_key(
    events: DataFrame, n: int, by: Sequence[str], path: str, checkpoint: str, salts: int = 8, idle: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Keep the last ``n`` events per key in the state store, and write those of the keys that a batch changes.

    A key's events are dealt to ``salts`` states by their ids, each of at most ``n`` events,
    so a model version that sends most of the events is several tasks' work; ``kept_events``
    reads the last ``n`` of them.  Late events take their place by time.  Keys that a batch
    does not have cost it nothing.

    With ``idle`` (as "7 days"; the events then need a watermark on ``ts``) a timer lets a
    state go whose newest event is that much older than the watermark.
    """
    fields = [events.schema[c] for c in by]
    columns = [c for c in events.columns]
    packed = events.select(
        *by,
        F.pmod(F.xxhash64("ts", "prediction_id"), F.lit(salts)).cast("int").alias("_salt"),
        F.coalesce(F.unix_micros("ts"), F.lit(_EARLIEST)).alias("_at"),
        F.coalesce(F.col("prediction_id").cast("long"), F.lit(_EARLIEST)).alias("_id"),
        F.to_json(F.struct(*columns), _TIMES).alias("_event"),
        *(["ts"] if idle and "ts" not in by else []),
    )
    wait = _milliseconds(events.sparkSession, idle) if idle else None
    timeout = GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout
    names_ = [*by, "_salt"]

    def renew(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([[*key, None]], columns=[*names_, "_event"])
            return
        before = list(zip(*state.get, strict=True)) if state.exists else []
        rows = list(before)
        for frame in frames:
            rows += zip(frame["_at"].tolist(), frame["_id"].tolist(), frame["_event"].tolist(), strict=True)
        rows = heapq.nlargest(n, rows)
        if rows != before:
            state.update(tuple(list(c) for c in zip(*rows, strict=True)))
        if wait is not None:
            state.setTimeoutTimestamp(max(rows[0][0] // 1000 + wait, state.getCurrentWatermarkMs() + 1))
        if rows != before:
            yield pd.DataFrame([[*key, r[2]] for r in rows], columns=[*names_, "_event"])

    output = T.StructType([*fields, T.StructField("_salt", T.IntegerType()), T.StructField("_event", T.StringType())])
    held = T.StructType.fromDDL("at array<bigint>, id array<bigint>, event array<string>")
    changed = packed.groupBy(*names_).applyInPandasWithState(renew, output, held, "update", timeout)
    return to_keyed_table(changed, path, checkpoint, names_, available_now)


def kept_events(spark: SparkSession, path: str, schema: T.StructType, n: int, by: Sequence[str]) -> DataFrame:
    """The last ``n`` events per key, with the columns of the stream, as its latest batch left them."""
    fields = [schema[c] for c in by]
    own = T.StructType([*fields, T.StructField("_salt", T.IntegerType()), T.StructField("_event", T.StringType())])
    rows = newest_rows(spark, path, [*by, "_salt"], own).filter("_event is not null")
    events = rows.select(F.from_json("_event", schema, _TIMES).alias("e")).select("e.*")
    return latest(events, n, by).select(*schema.names)


def _milliseconds(spark: SparkSession, interval: str) -> int:
    seconds = F.unix_timestamp(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {interval}"))
    return spark.range(1).select(seconds).first()[0] * 1000
