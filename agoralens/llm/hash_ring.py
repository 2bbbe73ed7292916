"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Each shard has many points on the ring of 64-bit hashes, and a row belongs to the next
point clockwise.  A shard takes rows until it is full; those that find it full go on to
the next point.  The bounds add up to the number of rows, so shards differ by one row
at most, and a change of the number of shards moves little more than must move.

Only counts decide: the driver sees the rows of each arc between two points, as many
numbers as there are points, walks the overflow round the ring and returns which ranks
of each arc go to which shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

POINTS = 64
# Rows that one task ranks, or so.
RANKED = 50_000


def ring(shards: int, points: int = POINTS) -> list[tuple[int, int]]:
    """(position, shard) in the order of positions."""
    placed = [
        (int.from_bytes(hashlib.md5(f"shard {s} point {p}".encode()).digest()[:8], "big", signed=True), s)
        for s in range(shards) for p in range(points)
    ]
    return sorted(placed)


def walk(arcs: dict[int, int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end, shard, first slot): where the rows of each arc go.

    All arcs offer their rows to their own point; then what was too much is offered to
    the next point, and so on round the ring.  The first ``rows % shards`` shards hold
    one row more than the others.
    """
    rows = sum(arcs.values())
    room = [rows // shards + (s < rows % shards) for s in range(shards)]
    held = [0] * shards
    waiting = [[(a, 0, arcs[a])] if arcs.get(a) else [] for a in range(len(owners))]
    parts = []
    while any(waiting):
        following: list[list[tuple[int, int, int]]] = [[] for _ in owners]
        for point, offered in enumerate(waiting):
            shard = owners[point]
            for arc, first, end in offered:
                taken = min(end - first, room[shard] - held[shard])
                if taken:
                    parts.append((arc, first, first + taken, shard, held[shard]))
                    held[shard] += taken
                if first + taken < end:
                    following[(point + 1) % len(owners)].append((arc, first + taken, end))
        waiting = following
    return parts


def shard_rows(
    df: DataFrame, shards: int, id_column: str = "doc_id", text: str = "text", points: int = POINTS
) -> DataFrame:
    """(id, size, text_crc32, shard, slot) for each row.

    ``size`` is 8 and the bytes of the text; a null text has none.  Shards have equal
    numbers of rows, or one more; ``slot`` counts the rows of a shard from 0.  A row's
    place on the ring is the hash of its id and text, so rows without an id spread by
    their texts.  Equal rows are counted before they meet and get neighbouring ranks.
    An empty table gives an empty result; with fewer rows than shards some stay empty.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(id_column).cast("long").alias("key"), (F.octet_length(own) + 8).cast("long").alias("size"),
        F.crc32(own.cast("binary")).alias("crc"), F.xxhash64(F.col(id_column).cast("long"), own).alias("h"),
    )
    rows = rows.groupBy("key", "size", "crc", "h").agg(F.count(F.lit(1)).alias("copies"))
    placed = ring(shards, points)
    at, owners = np.array([p for p, _ in placed], np.int64), [s for _, s in placed]

    def arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arc = np.searchsorted(at, batch["h"].to_numpy()) % len(at)
            yield pa.record_batch([*batch.columns, pa.array(arc.astype(np.int32))], [*batch.schema.names, "arc"])

    rows = materialize(rows.mapInArrow(arcs, "key long, size long, crc long, h long, copies long, arc int"), "ring")
    total = rows.agg(F.sum("copies")).first()[0] or 0
    bits = max(1, (total // RANKED * 2).bit_length())
    rows = rows.withColumn("piece", F.shiftright("h", 64 - bits))
    counts = rows.groupBy("arc", "piece").agg(F.sum("copies").alias("n"))
    before = F.sum("n").over(Window.partitionBy("arc").orderBy("piece")) - F.col("n")
    counts = counts.withColumn("before", before)
    held = {r.arc: r.n for r in counts.groupBy("arc").agg(F.sum("n").alias("n")).collect()}
    parts = df.sparkSession.createDataFrame(
        walk(held, owners, shards), "arc int, first long, end long, shard int, slot long"
    )
    within = Window.partitionBy("arc", "piece").orderBy("h", "key", "size", "crc")
    ranked = rows.join(counts.select("arc", "piece", "before"), ["arc", "piece"]).withColumn(
        "rank", F.col("before") + F.sum("copies").over(within) - F.col("copies")
    )
    each = ranked.select("key", "size", "crc", "arc", F.explode(F.sequence("rank", F.col("rank") + F.col("copies") - 1)).alias("rank"))
    # At most a few rows for each point of the ring.
    return (
        each.join(F.broadcast(parts), "arc").filter("rank >= first and rank < end")
        .select(F.col("key").alias(id_column), "size", F.col("crc").alias("text_crc32"), "shard",
                (F.col("slot") + F.col("rank") - F.col("first")).alias("slot"))
    )
