"""Chunks of documents that learn, bucket by bucket, which of their keys others have.

Documents are dealt into chunks of a bounded number of bytes by a hash of their id.  A
chunk sends each distinct key that it holds once, packed by key bucket; a task that has
one bucket compares the keys of all chunks and answers each chunk with a string of bits
in the order of its keys.  So a key that a third of all documents hold is one entry of
each chunk, never a list of documents, and no pairs are made.

Texts are dealt to chunks by one shuffle, which all steps of a plan read again.
Everything is a shuffle of Spark's, so a lost executor's part is made again.

Order of documents: by id; rows without an id come last and are not before one another.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20
NO_ID = 2**63 - 1
ASKED = "chunk int, bucket int, n int, keys binary, docs binary"
ANSWER = "chunk int, step int, bucket int, data binary, first long"


def chunk_count(df: DataFrame, text: str, chunk_bytes: int = CHUNK_BYTES) -> int:
    """Chunks for the table: by its bytes, and at least as many as the session's shuffle partitions."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // chunk_bytes))


def into_chunks(df: DataFrame, id_column: str, text: str, chunks: int) -> DataFrame:
    """Rows as (chunk, key, text as bytes, row); ``row`` holds all columns of the input but the text."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != text]
    return df.select(
        _chunk(id_column, text, chunks).alias("chunk"),
        F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("key"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
        F.col(text).isNull().alias("absent"),
        F.struct(*rest).alias("row"),
    ).repartition(chunks, "chunk")


def _chunk(id_column: str, text: str, chunks: int):
    key = F.coalesce(F.col(id_column).cast("long"), F.xxhash64(text))
    return F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int")


def copies(df: DataFrame, id_column: str, text: str, chunks: int) -> DataFrame:
    """Answers of step 0: for each text that several rows hold, its first document, sent to every chunk that has it.

    Rows are counted per text and chunk before they meet, so a group of copies of any
    size is at most one row per chunk.
    """
    each = df.select(
        _chunk(id_column, text, chunks).alias("chunk"),
        F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).alias("data"),
        F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("key"),
    )
    held = each.groupBy("data", "chunk").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("rows"))
    first = held.groupBy("data").agg(F.min("key").alias("first"), F.sum("rows").alias("rows")).filter("rows > 1")
    return held.select("data", "chunk").join(first, "data").select(
        "chunk", F.lit(0).alias("step"), F.lit(0).alias("bucket"), "data", "first"
    )


class Chunk:
    """The documents of a chunk in their order, and the answers that it has got."""

    def __init__(self, documents: pa.Table, answers: pa.Table):
        texts = documents["text"].combine_chunks()
        keys = documents["key"].to_numpy()
        order = np.argsort(keys, kind="stable")
        if len(np.unique(keys)) < len(keys):  # rows of one id: the same order whatever the shuffle's
            digests = [hashlib.md5(t.as_buffer()).digest() for t in texts]
            order = np.array(sorted(order.tolist(), key=lambda i: (keys[i], digests[i])), np.int64)
        self.table = documents.take(pa.array(order))
        self.keys = keys[order]
        texts = self.table["text"].combine_chunks()
        self.starts = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = texts.buffers()[2]
        self.data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.chunk = documents["chunk"][0].as_py()
        steps = answers["step"].to_numpy()
        first = answers["first"].to_numpy()
        data = answers["data"]
        known = {data[i].as_py(): first[i] for i in np.flatnonzero(steps == 0).tolist()}
        if known:
            digests = [hashlib.md5(t.as_buffer()).digest() for t in texts]
            self.copy = np.array([known.get(d, k) < k for d, k in zip(digests, self.keys.tolist(), strict=True)], bool)
        else:
            self.copy = np.zeros(len(self.keys), bool)
        buckets = answers["bucket"].to_numpy()
        self.answers = {
            s: {int(buckets[i]): data[i].as_py() for i in np.flatnonzero(steps == s).tolist()} for s in (1, 2)
        }

    def only(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the chosen rows one after the other, with the first byte of each and their length at the end."""
        sizes = np.diff(self.starts)[rows]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        if len(rows) == len(self.keys):
            return self.data[self.starts[0] : self.starts[-1]], starts
        parts = [self.data[self.starts[r] : self.starts[r + 1]] for r in rows.tolist()]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint8), starts


def grouped(buckets: np.ndarray):
    """(bucket, its rows) for the buckets that have rows; rows keep their order."""
    order = np.argsort(buckets, kind="stable")
    sorted_ = buckets[order]
    edges = np.flatnonzero(np.diff(sorted_)) + 1
    for rows in np.split(order, edges) if len(order) else []:
        yield int(buckets[rows[0]]), rows


def asked(chunk: int, buckets: np.ndarray, keys: np.ndarray, docs: np.ndarray | None) -> pa.Table:
    """One row per bucket with its keys in the given order.

    ``docs``: the first document of each key, in runs of (document, how many keys), or
    a bit that says whether the chunk itself has the key more than once.
    """
    rows = []
    for bucket, at in grouped(buckets):
        if docs.dtype == bool:
            more = np.packbits(docs[at]).tobytes()
        else:
            own = docs[at]
            edge = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            runs = np.diff(np.append(edge, len(own))).astype(np.uint32)
            more = own[edge].tobytes() + runs.tobytes()
        rows.append((chunk, bucket, len(at), keys[at].tobytes(), more))
    names = ("chunk", "bucket", "n", "keys", "docs")
    types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)})


def held_again(requests: pa.Table) -> pa.Table:
    """Step 1 for one bucket of 32-bit keys: a bit for each key that occurs more than once anywhere."""
    keys, more, sizes = _unpacked(requests, np.uint32, bits=True)
    order = np.argsort(keys)
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    again = np.zeros(len(keys), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    return _answers(requests, 1, again | more, sizes)


def held_before(requests: pa.Table) -> pa.Table:
    """Step 2 for one bucket of 64-bit keys: a bit for each key that a document of another chunk before the chunk's first one has."""
    keys, docs, sizes = _unpacked(requests, np.uint64, bits=False)
    order = np.argsort(keys)
    ordered = keys[order]
    heads = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(keys) else np.zeros(0, np.int64)
    before = np.zeros(len(keys), bool)
    if len(keys):
        first = np.minimum.reduceat(docs[order], heads)
        group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(keys))))
        before[order] = first[group] < docs[order]
    return _answers(requests, 2, before, sizes)


def _unpacked(requests: pa.Table, kind, bits: bool):
    sizes = requests["n"].to_numpy()
    keys, docs = [], []
    for n, key, more in zip(sizes.tolist(), requests["keys"], requests["docs"], strict=True):
        keys.append(np.frombuffer(key.as_buffer(), kind))
        more = more.as_buffer()
        if bits:
            docs.append(np.unpackbits(np.frombuffer(more, np.uint8), count=n).astype(bool))
        else:
            runs = len(more) // 12
            docs.append(np.repeat(np.frombuffer(more, np.int64, runs), np.frombuffer(more, np.uint32, runs, 8 * runs)))
    return np.concatenate(keys), np.concatenate(docs), sizes


def _answers(requests: pa.Table, step: int, bits: np.ndarray, sizes: np.ndarray) -> pa.Table:
    n = len(sizes)
    parts = np.split(bits, np.cumsum(sizes)[:-1])
    return pa.table({
        "chunk": requests["chunk"].combine_chunks(),
        "step": pa.array(np.full(n, step, np.int32)),
        "bucket": requests["bucket"].combine_chunks(),
        "data": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary()),
        "first": pa.array(np.zeros(n, np.int64)),
    })


def answered(answers: dict[int, bytes], buckets: np.ndarray) -> np.ndarray:
    """The bits for keys that were asked for with ``asked`` in this order."""
    out = np.zeros(len(buckets), bool)
    for bucket, at in grouped(buckets):
        out[at] = np.unpackbits(np.frombuffer(answers[bucket], np.uint8), count=len(at)).astype(bool)
    return out


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket from the upper half of each identifier."""
    return ((ids >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16 if buckets < 2**16 else np.int64)


class Anchors:
    """Anchors of a chunk: their positions, and the distinct (bucket, 32-bit key) they stand for."""

    def __init__(self, ids: np.ndarray, buckets: int):
        full = (ids >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | ids & np.uint64(0xFFFFFFFF)
        self.distinct, self.of, counts = np.unique(full, return_inverse=True, return_counts=True)
        self.again = counts > 1
        self.buckets = (self.distinct >> np.uint64(32)).astype(np.int64)

    def ask(self, chunk: int) -> pa.Table:
        return asked(chunk, self.buckets, self.distinct.astype(np.uint32), self.again)

    def shared(self, answers: dict[int, bytes]) -> np.ndarray:
        """For each anchor, whether the table has it more than once."""
        return answered(answers, self.buckets)[self.of]


class Occurrences:
    """Windows of a chunk in document order, grouped by identifier.

    ``rows`` is the row of each window and ``keys`` the id of each row.
    """

    def __init__(self, ids: np.ndarray, second: np.ndarray, rows: np.ndarray, keys: np.ndarray, buckets: int):
        n = len(ids)
        order = np.argsort(ids)
        sorted_ = ids[order]
        new = np.append(True, sorted_[1:] != sorted_[:-1]) if n else np.zeros(0, bool)
        group = np.cumsum(new).astype(np.uint64) - np.uint64(1)
        both = np.sort(group << np.uint64(32) | order.astype(np.uint64))  # by group, then in document order
        self.at = (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.group = (both >> np.uint64(32)).astype(np.int64)
        heads = np.flatnonzero(new)
        self.first = self.at[heads]
        self.rows, self.keys = rows, keys
        self.ids = ids
        self.order = np.argsort(self.first)  # the order in which groups are asked for: that of their first windows
        self.buckets = ((second[self.first[self.order]] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)

    def ask(self, chunk: int) -> pa.Table:
        first = self.first[self.order]
        return asked(chunk, self.buckets, self.ids[first], self.keys[self.rows[first]])

    def later(self, answers: dict[int, bytes], within: bool) -> np.ndarray:
        """For each window, whether an earlier document has it or, if ``within``, its own document at an earlier place."""
        elsewhere = np.zeros(len(self.first), bool)
        elsewhere[self.order] = answered(answers, self.buckets)
        key = self.keys[self.rows[self.at]]
        found = elsewhere[self.group] | (key > self.keys[self.rows[self.first]][self.group])
        if within and len(self.at):
            found[1:] |= (self.group[1:] == self.group[:-1]) & (self.rows[self.at[1:]] == self.rows[self.at[:-1]])
        out = np.zeros(len(self.at), bool)
        out[self.at] = found
        return out


def spread(length: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Positions of [0, length) that lie in one of the ranges [first, last)."""
    change = np.zeros(length + 1, np.int32)
    np.add.at(change, first, 1)
    np.add.at(change, last, -1)
    return np.cumsum(change[:-1], dtype=np.int32) > 0
