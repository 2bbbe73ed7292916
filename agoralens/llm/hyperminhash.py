"""Near-duplicate documents by HyperMinHash registers, with every link confirmed on full sets.

A document is the set of its 4-word shingles.  Register j keeps, of the least hash that
the set has under hash function j, the count of leading zeros and the ten bits after
the leading one: 15 bits instead of 32.  (Each register has a hash function of its own
rather than a share of the elements, so short documents fill all registers, too.)
Documents that agree on all six registers of one of 42 bands are candidates; at a
similarity of 0.8 a pair misses every band once in about 350,000 times, and the more
alike, the rarer.  The share of equal registers, less what chance makes equal,
estimates the similarity; candidates 6 standard errors below the threshold go, the
others are compared on their full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .components import components
from .identifiers import mix, wider, words_of
from .texts import LOWER, pieces

SHINGLE = 4
BANDS, ROWS = 42, 6
REGISTERS = BANDS * ROWS
MANTISSA = 10
PERCENT = 80
# Six standard errors of the share of equal registers at the threshold.
SLACK = 6 * (PERCENT / 100 * (1 - PERCENT / 100) / REGISTERS) ** 0.5
_RANDOM = np.random.Generator(np.random.PCG64(7))
_FLIP = _RANDOM.integers(0, 2**32, REGISTERS, dtype=np.uint32)
_TIMES = _RANDOM.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; one of the whole text if it has fewer words."""
    _, _, ids, counts = words_of(LOWER[data], starts)
    runs = wider(wider(ids, 1, 2), 2, SHINGLE)
    first = np.concatenate([[0], np.cumsum(counts)])
    sets = []
    for start, n in zip(first[:-1].tolist(), counts.tolist(), strict=True):
        if n >= SHINGLE:
            sets.append(np.unique(runs[start : start + n - SHINGLE + 1]))
        else:
            whole = np.full(min(n, 1), n, np.uint64)
            for word in ids[start : start + n]:
                whole = mix(whole, np.array([word]))
            sets.append(whole)
    return sets


def registers(shingles: np.ndarray) -> np.ndarray:
    """Exponent and leading mantissa bits of the least hash of each register."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 2**32 - 1, np.uint32)
    for i in range(0, len(short), 256):
        hashed = short[i : i + 256, None] ^ _FLIP
        hashed *= _TIMES
        np.minimum(least, hashed.min(axis=0), out=least)
    bits = np.maximum(least, 1).astype(np.float64).view(np.uint64)
    return ((bits >> np.uint64(52 - MANTISSA)) - np.uint64(1023 << MANTISSA)).astype(np.uint16)


def similarity(a: np.ndarray, b: np.ndarray, n, m):
    """Estimated Jaccard similarity from registers, corrected for those that agree by chance.

    ``n`` and ``m`` are the sizes of the sets.  Two independent least hashes share a
    register with probability 0.17 * 4nm / (n + m)**2 / 2**MANTISSA.
    """
    chance = 0.169919487 * 4 * n * m / (n + m) ** 2 / 2**MANTISSA
    return (np.mean(a == b, axis=-1) - chance) / (1 - chance)


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Classes of documents linked by a shingle similarity of 0.8 or more.

    Words are runs of other than the six ASCII white space characters, with A-Z in
    lower case.  Returns, for each row of the input, its id, ``n_shingles``,
    ``component_id`` (the smallest id that links lead to, its own included) and
    ``kept`` (whether that is its own).

    Null and empty texts have no shingles and are linked with nothing.  A row without
    an id is linked with nothing, has no component and is kept.  Rows that share an id
    are one document: what one of them links to, all do.  An empty table gives an
    empty result.

    Documents with equal sets are one class, of which only the smallest id goes on.  In
    a bucket of a band each class is compared with the smallest; what that leaves
    unlinked meets by its rarest shingles (``_across``), so no link within a bucket is
    lost, and a bucket of a template's pages is not compared pair by pair.
    """
    documents = df.select(F.col(id_column).cast("long").alias("key"), F.col(text).alias("text"))
    signed = materialize(
        documents.mapInArrow(_signatures, "key long, n long, digest binary, registers binary"), "signatures"
    )
    linkable = signed.filter("n > 0 and key is not null")
    classes = linkable.groupBy("digest").agg(
        F.min("key").alias("key"), F.first("n").alias("n"), F.first("registers").alias("registers")
    )
    bands = F.array(*[
        F.xxhash64(F.lit(i), F.substring("registers", 2 * ROWS * i + 1, 2 * ROWS)) for i in range(BANDS)
    ])
    banded = classes.select("key", F.explode(bands).alias("band"))
    hubs = banded.groupBy("band").agg(F.min("key").alias("hub"), F.count(F.lit(1)).alias("c"))
    members = materialize(banded.join(hubs.filter("c > 1").select("band", "hub"), "band"), "buckets")

    # Classes of several rows and their first documents; documents of several classes link these.
    several = linkable.groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("c"))
    several = materialize(several.filter("c > 1").select("digest", "first"), "classes")  # a join that can split a hot class
    rows = signed.select("key", "n", "digest").join(several, "digest", "left")
    rows = rows.withColumn("first", F.when(F.col("key").isNotNull(), F.coalesce("first", "key")))
    split = linkable.groupBy("key").agg(F.min("digest").alias("d"), F.max("digest").alias("e")).filter("d <> e")
    shared = rows.join(split.select("key"), "key", "left_semi").filter("first <> key")

    sets = _sets_of(documents, members.select("key").distinct())
    pairs = members.filter("key <> hub").select(F.col("hub").alias("a"), F.col("key").alias("b"))
    links = _confirmed(sets, materialize(pairs.distinct(), "pairs"))
    links = links.unionByName(shared.select(F.col("first").alias("a"), F.col("key").alias("b")))
    component = materialize(components(links), "components")
    more = _across(members, component, sets)
    if more is not None:
        component = materialize(components(links.unionByName(more)), "components")

    found = F.coalesce("component", "first")
    return rows.join(component.withColumnsRenamed({"key": "first"}), "first", "left").select(
        F.col("key").alias(id_column), F.col("n").alias("n_shingles"), found.alias("component_id"),
        F.coalesce(F.col("key") == found, F.lit(True)).alias("kept"),
    )


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, starts in pieces(batch):
            sets = shingle_sets(data, starts)
            yield pa.record_batch({
                "key": rows["key"],
                "n": pa.array([len(s) for s in sets], pa.int64()),
                "digest": pa.array([hashlib.md5(s).digest() if len(s) else None for s in sets], pa.binary()),
                "registers": pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary()),
            })


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, starts in pieces(batch):
            sets = shingle_sets(data, starts)
            yield pa.record_batch({
                "key": rows["key"],
                "registers": pa.array([registers(s).tobytes() for s in sets], pa.binary()),
                "shingles": pa.array([s.tobytes() for s in sets], pa.binary()),
            })


def _sets_of(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """Registers and sets of some documents; the keys are at rest, so the planner knows how many there are."""
    texts = documents.join(materialize(keys, "needed"), "key").select("key", "text")
    return materialize(texts.mapInArrow(_sets, "key long, registers binary, shingles binary"), "sets")


def _confirmed(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose sets have the similarity."""
    one, two = (sets.select(*[F.col(c).alias(f"{c}_{s}") for c in sets.columns]) for s in "ab")
    both = pairs.join(two, F.col("b") == F.col("key_b")).join(one, F.col("a") == F.col("key_a"))
    columns = ["a", "b", "registers_a", "registers_b", "shingles_a", "shingles_b"]
    return materialize(both.select(*columns).mapInArrow(_compared, "a long, b long"), "confirmed")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buffers = [batch[c] for c in ("registers_a", "registers_b", "shingles_a", "shingles_b")]
        linked = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            ra, rb = (np.frombuffer(c[i].as_buffer(), np.uint16) for c in buffers[:2])
            sa, sb = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in buffers[2:])
            n, m = len(sa), len(sb)
            if 100 * min(n, m) < PERCENT * max(n, m) or similarity(ra, rb, n, m) < PERCENT / 100 - SLACK:
                continue
            common = len(np.intersect1d(sa, sb, assume_unique=True))
            linked[i] = 100 * common >= PERCENT * (n + m - common)
        yield batch.select(["a", "b"]).filter(pa.array(linked))


def _across(members: DataFrame, component: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Links between members of a bucket that are not in one component; None if there can be none.

    The bucket's first key has been compared with all.  The others of buckets with
    several components are joined on a prefix of each set: with the shingles of all of
    them in one order, the rarest first, two sets of the similarity have a shingle in
    common among the first fifth or so of each.  What many share comes last in that
    order, so pages of one template meet only where their own parts are alike.  A pair
    must also be in different components, near enough in size, and have enough of both
    sets left from the common shingle on, which holds for the first they have in common.
    """
    others = members.filter("key <> hub").join(component, "key", "left").select(
        "band", "key", F.coalesce("component", "key").alias("component")
    )
    ends = others.groupBy("band").agg(F.min("component").alias("first"), F.max("component").alias("last"))
    torn = materialize(ends.filter("first < last").select("band"), "torn")
    rest = materialize(others.join(torn, "band").select("key", "component").distinct(), "apart")
    if rest.isEmpty():
        return None
    shingled = rest.join(sets.select("key", "shingles"), "key").mapInArrow(
        _exploded, "key long, component long, n int, shingle long"
    )
    frequent = shingled.groupBy("shingle").agg(F.count(F.lit(1)).alias("c"))
    ordered = shingled.join(frequent, "shingle").groupBy("key", "component", "n").agg(
        F.sort_array(F.collect_list(F.struct("c", "shingle"))).alias("order")
    )
    length = F.expr(f"cast(n - ({PERCENT} * n + 99) div 100 + 1 as int)")
    prefix = ordered.select("key", "component", "n", F.posexplode(F.slice("order", F.lit(1), length)).alias("at", "own"))
    prefix = materialize(prefix.filter("own.c > 1").select("key", "component", "n", "at", "own.shingle"), "prefixes")
    a, b = prefix.alias("a"), prefix.alias("b")
    met = a.join(b, F.expr(
        "a.shingle = b.shingle and a.key < b.key and a.component <> b.component"
        f" and 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)"
        f" and {100 + PERCENT} * least(a.n - a.at, b.n - b.at) >= {PERCENT} * (a.n + b.n)"
    ))
    pairs = materialize(met.select(F.col("a.key").alias("a"), F.col("b.key").alias("b")).distinct(), "met")
    return _confirmed(sets, pairs)


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per shingle."""
    for batch in batches:
        sets = [np.frombuffer(s.as_buffer(), np.int64) for s in batch["shingles"]]
        n = np.array([len(s) for s in sets])
        row = np.repeat(np.arange(len(n)), n)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        key, component = batch["key"].to_numpy(), batch["component"].to_numpy()
        for i in range(0, len(flat), 1 << 17):
            own = row[i : i + (1 << 17)]
            yield pa.record_batch({
                "key": pa.array(key[own]), "component": pa.array(component[own]), "n": pa.array(n[own], pa.int32()),
                "shingle": pa.array(flat[i : i + (1 << 17)]),
            })
