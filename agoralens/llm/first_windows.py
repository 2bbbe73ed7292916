"""The plan that both exact substring operators share: anchors, then windows, then the verdict."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ..session import materialize
from .exchange import ANSWER, ASKED, CHUNK_BYTES, Chunk, chunk_count, copies, held_again, held_before, into_chunks
from .texts import with_row


def first_windows(
    df: DataFrame,
    id_column: str,
    text: str,
    anchors: Callable[[Chunk, int], pa.Table],
    windows: Callable[[Chunk, int], pa.Table],
    verdict: Callable[[Chunk, int], pa.Table],
    result: str,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Run the three steps over the chunks of the table.

    ``anchors`` asks which anchors occur again; ``windows`` asks, for windows that hold
    such an anchor, which a document before has; ``verdict`` makes the columns
    ``result`` of each row of the chunk, to which the row itself is added as ``row``.
    """
    n = chunk_count(df, text, chunk_bytes)
    documents = into_chunks(df, id_column, text, n)
    same = materialize(copies(df, id_column, text, n), "copies")

    def asks(function):
        return lambda left, right: function(Chunk(left, right), n)

    def over_chunks(answers: DataFrame, function, schema: str | StructType) -> DataFrame:
        return documents.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(function, schema)

    def by_bucket(requests: DataFrame, function) -> DataFrame:
        return requests.groupBy("bucket").applyInArrow(function, ANSWER)

    again = by_bucket(over_chunks(same, asks(anchors), ASKED), held_again)
    before = by_bucket(over_chunks(same.unionAll(again), asks(windows), ASKED), held_before)

    def final(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = Chunk(left, right)
        out = verdict(chunk, n)
        return out.add_column(0, "row", chunk.table["row"])

    return over_chunks(same.unionAll(again).unionAll(before), final, with_row(documents, result))
