"""Texts of Arrow batches as numpy arrays, in pieces of a bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

PIECE = 2 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose texts have ``limit`` bytes or so, or one longer row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(), dtype=np.int64)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def pieces(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their bytes one after the other, first byte of each and the length of all) of each slice.

    A null text has no bytes.
    """
    for rows in slices(batch, text):
        parts = [t.as_buffer() if t.is_valid else b"" for t in rows[text]]
        yield rows, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


def with_row(packed: DataFrame, result: str) -> StructType:
    """The type of the column ``row`` and those of the results."""
    return StructType([packed.schema["row"], *StructType.fromDDL(result).fields])
