"""Token ids packed into rows of equal length, by best fit on decreasing lengths."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 2048
PACKED_TOKENS = 4 << 20
RESULT = (
    "pack long, row int, n_tokens int, ids binary, positions binary, "
    "segments array<int>, documents array<long>, offsets array<long>"
)


class Capacities:
    """Rows by free capacity, and a segment tree that finds the least capacity of a row that fits."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.tree = bytearray(2 * self.size)  # whether a capacity of the node's range has rows
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, row: int, capacity: int) -> None:
        self.rows[capacity].append(row)
        node = capacity + self.size
        while node and not self.tree[node]:
            self.tree[node] = 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The row with the least capacity of ``least`` or more, and that capacity; it is taken out."""
        node = least + self.size
        if not self.tree[node]:
            while node and not (node % 2 == 0 and self.tree[node + 1]):
                node >>= 1
            if not node:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.tree[2 * node] else 2 * node + 1
        capacity = node - self.size
        row = self.rows[capacity].pop()
        if not self.rows[capacity]:
            self.tree[node] = 0
            while node > 1 and not (self.tree[node] or self.tree[node ^ 1]):
                node >>= 1
                self.tree[node] = 0
        return row, capacity


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Items of at most ``length``, by decreasing size, each in the row that it fills best."""
    free = Capacities(length)
    rows: list[list[int]] = []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = free.take(sizes[item])
        row, capacity = found if found else (len(rows), length)
        if not found:
            rows.append([])
        rows[row].append(item)
        free.add(row, capacity - sizes[item])
    return rows


def _packed(pack: int, keys: list, ids: list[np.ndarray], length: int, pad: int, kind: str) -> pa.RecordBatch:
    pieces = [(d, o) for d, own in enumerate(ids) for o in range(0, max(len(own), 1), length)]
    sizes = [min(length, len(ids[d]) - o) for d, o in pieces]
    rows = best_fit(sizes, length)
    columns: dict[str, list] = {n: [] for n in ("n_tokens", "ids", "positions", "segments", "documents", "offsets")}
    for row in rows:
        matrix, positions = np.full(length, pad, kind), np.zeros(length, "<u4")
        ends = np.cumsum([0] + [sizes[i] for i in row])
        for i, start, end in zip(row, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            d, o = pieces[i]
            matrix[start:end] = ids[d][o : o + sizes[i]]
            positions[start:end] = np.arange(end - start)
        columns["n_tokens"].append(int(ends[-1]))
        columns["ids"].append(matrix.tobytes())
        columns["positions"].append(positions.astype("<u2" if length <= 1 << 16 else "<u4").tobytes())
        columns["segments"].append(ends.tolist())
        columns["documents"].append([keys[pieces[i][0]] for i in row])
        columns["offsets"].append([pieces[i][1] for i in row])
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
    return pa.record_batch({
        "pack": pa.array(np.full(len(rows), pack, np.int64)), "row": pa.array(np.arange(len(rows), dtype=np.int32)),
        **{n: pa.array(v, k) for (n, v), k in zip(columns.items(), kinds, strict=True)},
    })


def pack(
    df: DataFrame, tokens: Callable[[list], list[np.ndarray]], column: str, vocabulary: int, id_column: str = "doc_id",
    length: int = LENGTH, packed_tokens: int = PACKED_TOKENS,
) -> DataFrame:
    """Rows of ``length`` token ids, each made of whole documents or pieces of long ones.

    ``tokens`` turns a list of values of ``column`` into their ids; ``vocabulary`` is the
    number of ids, itself the padding.  Each row has ``ids`` and ``positions`` (from 0 in
    each segment) as little-endian integers, 16 bits wide if the numbers allow and 32 if
    not; ``segments``, the cumulative lengths from 0; and for each segment its document
    and the place of its first token there.  (``pack``, ``row``) is unique.

    A document longer than a row is cut into full rows and a rest, which is packed as
    others are; nothing is dropped.  Null and empty documents are segments of length 0.
    A null id stays null.  Repeated rows are packed as often as they occur.  An empty
    table gives an empty result.

    A task packs what it reads, some ``packed_tokens`` at a time, so nothing is
    shuffled and memory is bounded; which documents share a row follows the layout of
    the input.
    """
    kind = "<u2" if vocabulary < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keys: list = []
        ids: list[np.ndarray] = []
        number, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for key, own in zip(batch["key"].to_pylist(), tokens(batch["value"].to_pylist()), strict=True):
                keys.append(key)
                ids.append(own)
                held += len(own)
                if held >= packed_tokens:
                    yield _packed(number, keys, ids, length, vocabulary, kind)
                    keys, ids, number, held = [], [], number + 1, 0
        if keys:
            yield _packed(number, keys, ids, length, vocabulary, kind)

    return df.select(F.col(id_column).cast("long").alias("key"), F.col(column).alias("value")).mapInArrow(run, RESULT)


def binary_ids(values: list) -> list[np.ndarray]:
    """Ids from little-endian 32-bit integers as bytes."""
    return [np.frombuffer(v or b"", "<u4") for v in values]


class RankIds:
    """Ids of texts by a file of byte-pair ranks, which the driver reads; it has a few MB whatever the data."""

    def __init__(self, spark, path: str, pattern: str):
        with open(path, "rb") as file:
            self.sent, self.pattern = spark.sparkContext.broadcast(file.read()), pattern
        self.vocabulary = self.sent.value.count(b"\n")
        self.encoding = None

    def __call__(self, texts: list) -> list[np.ndarray]:
        if self.encoding is None:
            import base64

            import tiktoken

            lines = [line.split() for line in self.sent.value.splitlines()]
            ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
            self.encoding = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return [np.array(self.encoding.encode_ordinary(t or ""), np.uint32) for t in texts]
