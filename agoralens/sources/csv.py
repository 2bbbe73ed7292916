"""Quoted CSV read by many tasks, although a record may span lines and splits.

Whether a line starts a record depends on the number of quotes before it in the file:
it does if that is even.  Each split counts its quotes; the sums over the splits before
give each its parity, from which it finds its own records.  What crosses the edge of a
split is a fragment or two of each, which are put together apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PIECES = "file string, block long, kind int, record string"
_WHOLE, _HEAD, _TAIL = 0, 1, 2
_QUOTES = {"escape": '"'}


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV files with a header, quoted by ``"`` and doubled quotes, typed by the schema.

    The columns are those of the header.  Every file is read in splits as a text is, so
    one large file is many tasks' work; a compressed one can't be split.
    """
    columns = spark.read.option("header", True).options(**_QUOTES).csv(path).columns
    unknown = sorted(set(columns) - set(schema.names))
    if unknown:
        raise ValueError(f"columns without a type: {', '.join(unknown)}")
    typed = T.StructType([schema[c] for c in columns])
    parsed = F.from_csv("record", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in typed), _QUOTES)
    return records(spark, path).select(parsed.alias("row")).select("row.*")


def records(spark: SparkSession, path: str) -> DataFrame:
    """The records of the files as strings, without headers and empty lines."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parity = counted.select("file", "block", F.coalesce(F.sum("quotes").over(before) % 2, F.lit(0)).cast("int").alias("odd"))
    # One row per split, and the lines keep their order.
    pieces = lines.join(F.broadcast(parity), ["file", "block"]).mapInArrow(_pieces, _PIECES)
    at = Window.partitionBy("file").orderBy("block", "kind")
    chained = pieces.filter(F.col("kind") != _WHOLE).withColumn("chain", F.sum(F.when(F.col("kind") == _TAIL, 1).otherwise(0)).over(at))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "kind", "record"))), lambda p: p["record"])
    joined = chained.groupBy("file", "chain").agg(F.min("block").alias("block"), F.array_join(parts, "\n").alias("record"))
    every = pieces.filter(F.col("kind") == _WHOLE).select("record").unionByName(joined.select("record"))
    # A header is told by the mark that the first line of a file gets.
    return every.filter(~F.startswith("record", F.lit("\x00"))).select(F.regexp_replace("record", "\r$", "").alias("record")).filter("record <> ''")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records, what ends one of an earlier split, and what starts one that a later split ends."""
    at, odd, held, kind = None, 0, [], _HEAD
    out: list[tuple[str, int, int, str]] = []

    def close(last: bool) -> None:
        nonlocal held, kind
        if held:
            ends = kind == _HEAD or (last and odd)
            out.append((*at, (kind if kind == _HEAD else _TAIL) if ends else _WHOLE, "\n".join(held)))
        held, kind = [], _WHOLE

    for batch in batches:
        files, blocks = batch["file"].to_pylist(), batch["block"].to_pylist()
        values, marks = batch["value"].to_pylist(), batch["odd"].to_pylist()
        quotes = pc.count_substring(batch["value"], '"').to_numpy(zero_copy_only=False)
        for file, block, value, mark, n in zip(files, blocks, values, marks, quotes.tolist(), strict=True):
            if (file, block) != at:
                close(last=True)
                at, odd, kind = (file, block), mark, _HEAD if mark else _WHOLE
                if block == 0:
                    value = "\x00" + value
            elif not odd:
                close(last=False)
            held.append(value)
            odd = (odd + n) % 2
        if out:
            yield _table(out)
            out = []
    close(last=True)
    if out:
        yield _table(out)


def _table(rows: list[tuple[str, int, int, str]]) -> pa.RecordBatch:
    file, block, kind, record = zip(*rows, strict=True)
    return pa.record_batch({
        "file": pa.array(file), "block": pa.array(block, pa.int64()), "kind": pa.array(np.array(kind, np.int32)), "record": pa.array(record),
    })
