"""Phrase collocations counted in the dictionary of a prefix-free parse.

Texts are cut into chunks at words that their own hash chooses, so equal passages are
cut alike wherever they stand.  A chunk reaches ``LONGEST - 1`` words into the next one of
its piece, so every phrase lies whole in the chunk that its first word belongs to and
is counted there alone.  Chunks that occur again are one entry of the dictionary with
the number of their parses; a phrase of a chunk counts that often.

The dictionary lies in parts of bounded size, dealt by a hash of the chunk.  A part
tells, for its distinct pairs of words, how often it has each, packed by key; a task
that has all counts of a key answers whether the pair can be frequent.  Longer phrases
are counted only if all their pairs are: a phrase is never more frequent than its parts.
The counts of phrases, by their whole strings, are added up at last.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import first_n_per_key
from ..session import materialize
from .exchange import answered, grouped
from .identifiers import mix, words_of
from .texts import LOWER, slices

LONGEST = 4
LEAST = 30
ABSORBED = 80
TOP = 2000
NO_LANGUAGE = "und"

# One word in so many starts a chunk.
TRIGGER = 16
PART_BYTES = 8 << 20
PARTITION_BYTES = 64 << 20
BUCKET_BYTES = 32 << 20
# Of a part, so many bytes of chunks or so many phrases are looked at together.
BLOCK_BYTES = 1 << 20
BLOCK_ROWS = 1 << 15

_BREAKS = np.zeros(256, bool)
_BREAKS[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_TABLE = LOWER.copy()
_TABLE[_BREAKS] = ord(" ")
# Between words of a chunk: in one piece, across pieces, and before the words that belong to the next chunk.
_SPACE, _BREAK, _NEXT = ord(" "), ord("\n"), ord("\v")

CHUNKS = "part int, lang string, chunk binary, parses long"
ASKED = "part int, bucket int, n int, keys binary, counts binary"
ANSWER = "part int, step int, bucket int, data binary"
COUNTED = "lang string, size int, phrase string, a long"


def collocations(
    df: DataFrame, text: str = "text", group: str = "lang", least: int = LEAST, absorbed: int = ABSORBED, top: int = TOP,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """The first ``top`` collocations of each group, with their counts and scores.

    A-Z count as lower case.  Pieces end at ``.,;:!?`` and line ends; words are runs of
    other than spaces and tabs.  Candidates are phrases of 2 to 4 words of one piece with
    ``a >= least`` occurrences, overlaps included.  Each cut of a candidate into a first
    part with ``l`` and a rest with ``r`` occurrences scores ``floor(2000000 a / (l + r))``; the
    lowest counts, of equal ones that of the shortest first part.  A candidate inside a
    longer one that has ``absorbed`` percent of its occurrences is dropped.

    Returns ``group``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` (all words of the group) and
    ``score``, ranked by score and occurrences, then by the phrase's bytes.  Null and empty
    texts have no words; rows without a group are the group ``und``.  Repeated rows count
    each time.  An empty table gives an empty result.
    """
    counted = materialize(phrase_counts(df, text, group, least, part_bytes), "phrases")
    return _ranked(counted, absorbed, top).withColumnsRenamed({"lang": group}).select(
        group, "rank", "phrase", "a", "l", "r", "n", "score"
    )


def phrase_counts(
    df: DataFrame, text: str = "text", group: str = "lang", least: int = LEAST, part_bytes: int = PART_BYTES
) -> DataFrame:
    """(lang, size, phrase, a) of words and phrases that occur ``least`` times; size 0 has all words of a group."""
    texts = df.select(F.coalesce(F.col(f"`{group}`").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col(f"`{text}`").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(usual, -(-size // PARTITION_BYTES))
    parts = max(partitions, -(-size // part_bytes))
    buckets = max(usual, -(-size // BUCKET_BYTES))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _parsed(batches, parts)

    dictionary = texts.mapInArrow(parse, CHUNKS).repartition(partitions, "part")

    def ask(own: pa.Table) -> pa.Table:
        return _Part(own, buckets).ask(least)

    def answer(requests: pa.Table) -> pa.Table:
        return _frequent(requests, least)

    def count(own: pa.Table, answers: pa.Table) -> pa.Table:
        return _Part(own, buckets).phrases({b.as_py(): d.as_py() for b, d in zip(answers["bucket"], answers["data"], strict=True)})

    asked = dictionary.groupBy("part").applyInArrow(ask, ASKED)
    frequent = asked.groupBy("bucket").applyInArrow(answer, ANSWER)
    phrases = dictionary.groupBy("part").cogroup(frequent.groupBy("part")).applyInArrow(count, COUNTED)
    sums = phrases.groupBy("lang", "size", "phrase").agg(F.sum("a").alias("a"))
    return sums.filter((F.col("a") >= least) | (F.col("size") == 0))


def _ranked(counted: DataFrame, absorbed: int, top: int) -> DataFrame:
    candidates = counted.filter("size > 1").select("lang", "phrase", "a", F.split("phrase", " ").alias("w"))

    def piece(first, size):
        return F.array_join(F.slice("w", first, size), " ")

    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("first"),
                       piece(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    known = counted.filter("size between 1 and 3")
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(part), F.col("a").alias(name)), ["lang", part])
    scored = cuts.select("lang", "phrase", "a", "k", "l", "r", F.expr(
        "(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"
    ).alias("score"))
    lowest = scored.groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut")
    ).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    # All shorter phrases inside a candidate, and how often the most frequent candidate around each occurs.
    inside = candidates.filter(F.size("w") > 2).select("lang", "a", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("m"))
    inside = inside.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)).alias("at"))
    around = inside.groupBy("lang", piece(F.col("at"), F.col("m")).alias("phrase")).agg(F.max("a").alias("longer"))
    longer = F.coalesce("longer", F.lit(0)).cast("decimal(20,0)")
    kept = lowest.join(around, ["lang", "phrase"], "left").filter(longer * 100 < F.col("a").cast("decimal(20,0)") * absorbed)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = first_n_per_key(kept.select("lang", "phrase", "a", "l", "r", "score"), ["lang"], order, top)
    words = counted.filter("size = 0").select("lang", F.col("a").alias("n"))
    return ranked.join(words, "lang").withColumn("rank", F.col("rank").cast("long"))


def _parsed(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """The chunks of a task's documents; those it has read again are counted, up to a bound on what it remembers."""
    known: dict[tuple[str, bytes], int] = {}
    held = 0
    for batch in batches:
        for rows in slices(batch):
            langs = rows["lang"].to_pylist()
            for row, chunk in _chunks(rows["text"]):
                key = (langs[row], chunk)
                before = known.get(key, 0)
                known[key] = before + 1
                if not before:
                    held += len(chunk) + 100
            if held > 8 * PART_BYTES:
                yield from _dealt(known, parts)
                known, held = {}, 0
    yield from _dealt(known, parts)


def _dealt(known: dict[tuple[str, bytes], int], parts: int) -> Iterator[pa.RecordBatch]:
    keys = list(known)
    for i in range(0, len(keys), 10_000):
        own = keys[i : i + 10_000]
        yield pa.record_batch({
            "part": pa.array([zlib.crc32(c, zlib.crc32(g.encode())) % parts for g, c in own], pa.int32()),
            "lang": pa.array([g for g, _ in own], pa.string()),
            "chunk": pa.array([c for _, c in own], pa.binary()),
            "parses": pa.array([known[k] for k in own], pa.int64()),
        })


def _chunks(texts: pa.Array) -> Iterator[tuple[int, bytes]]:
    """(row, chunk) of the texts: words with one mark between them, and another before the words of the next chunk."""
    parts = [t.as_buffer() if t.is_valid else b"" for t in texts]
    raw = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    starts = np.cumsum([0, *[len(p) + 1 for p in parts]])
    at, ends, ids, counts = words_of(_TABLE[raw], starts)
    n = len(at)
    if not n:
        return
    breaks = np.concatenate([[0], np.cumsum(_BREAKS[raw])])[at]  # before each word, breaks so far
    piece = np.append(True, breaks[1:] != breaks[:-1])
    row = np.repeat(np.arange(len(counts)), counts)
    new = np.append(True, row[1:] != row[:-1])
    cut = new | (mix(ids, np.full(1, 77, np.uint64)) % np.uint64(TRIGGER) == 0)
    # The bytes of the words, each with one mark behind it.
    data = LOWER[raw]
    mark = np.full(n, _SPACE, np.uint8)
    mark[:-1][piece[1:]] = _BREAK
    data[ends] = mark
    size = ends - at + 1
    begin = np.concatenate([[0], np.cumsum(size)])
    change = np.zeros(len(data) + 1, np.int8)
    change[at] += 1
    change[ends + 1] -= 1
    inside = np.cumsum(change[:-1], dtype=np.int8) > 0
    flat = data[inside].tobytes()
    first = np.flatnonzero(cut)
    last = np.append(first[1:], n)
    # Up to three words of the same piece that come after the chunk.
    group = np.cumsum(piece)
    reach = last.copy()
    for k in range(LONGEST - 1):
        more = (last + k < n) & (reach == last + k)
        more[more] = group[last[more] + k] == group[last[more] - 1]
        reach[more] += 1
    for r, a, b, c in zip(row[first].tolist(), begin[first].tolist(), begin[last].tolist(), begin[reach].tolist(), strict=True):
        own = flat[a : b - 1]
        yield r, own if b == c else own + b"\v" + flat[b : c - 1]


class _Part:
    """The words and phrases of the chunks of one part of the dictionary.

    Tasks of one executor hold a part each.  What is kept of each word is as narrow as
    its values; what is wider is made from a block of chunks or phrases at a time.
    """

    def __init__(self, chunks: pa.Table, buckets: int):
        self.part = chunks["part"][0].as_py()
        merged = chunks.group_by(["lang", "chunk"]).aggregate([("parses", "sum")])
        langs = merged["lang"].combine_chunks().dictionary_encode()
        self.names = langs.dictionary
        self.seeds = np.array([_seed(x) for x in self.names.to_pylist()], np.uint64)
        codes = langs.indices.to_numpy().astype(np.min_scalar_type(len(self.names)))
        parses = merged["parses_sum"].to_numpy()
        parses = parses.astype(np.min_scalar_type(int(parses.max())))
        # Words with one mark behind each; the last one of a chunk has that of another piece.
        texts = pc.binary_join_element_wise(merged["chunk"].combine_chunks(), b"", b"\n")
        del merged, langs
        starts = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1)
        self.raw = np.frombuffer(texts.buffers()[2], np.uint8, starts[-1])
        self.totals = np.zeros(len(self.names), np.int64)
        words = []
        row = 0
        while row < len(texts):
            stop = max(row + 1, int(np.searchsorted(starts, starts[row] + BLOCK_BYTES, side="right")) - 1)
            words.append(self._words(starts[row : stop + 1], codes[row:stop], parses[row:stop], buckets))
            row = stop
        # ``at``: the first byte of each word; ``left``: words of the piece from here on, up to the longest phrase;
        # ``keys``: bucket and 32 bits of each pair of words.
        at, self.ids, self.weights, self.code, self.left, self.keys = (np.concatenate(x) for x in zip(*words, strict=True))
        self.at = np.append(at, np.int32(len(self.raw)))

    def _words(self, starts: np.ndarray, codes: np.ndarray, parses: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
        """What is kept of the words of some chunks."""
        at, ends, ids, counts = words_of(self.raw[starts[0] : starts[-1]], starts - starts[0])
        marks = self.raw[starts[0] : starts[-1]][ends]
        code = np.repeat(codes, counts)
        weights = np.repeat(parses, counts)
        nexts = np.cumsum(marks == _NEXT) - (marks == _NEXT)
        weights[nexts > np.repeat(nexts[np.cumsum(counts) - counts], counts)] = 0  # counted in their own chunk
        self.totals += np.bincount(code, weights, len(self.totals)).astype(np.int64)
        left = np.ones(len(at), np.int8)
        run = marks != _BREAK
        for k in range(1, LONGEST):
            left += run
            more = max(0, len(run) - k)
            run[:more] &= marks[k:] != _BREAK
            run[more:] = False
        pairs = np.flatnonzero(left >= 2)
        full = mix(mix(ids[pairs], ids[pairs + 1]), self.seeds[code[pairs]])
        keys = (full >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | full & np.uint64(0xFFFFFFFF)
        return (at + starts[0]).astype(np.int32), ids, weights, code, left, keys

    def ask(self, least: int) -> pa.Table:
        """Each distinct pair of words once, with what it counts here up to ``least``."""
        order, heads = _equal(self.keys)
        distinct = self.keys[order[heads]]
        counts = np.minimum(_sums(self.weights[self.left >= 2][order], heads), least).astype(np.min_scalar_type(least))
        keys = distinct.astype(np.uint32)
        rows = [(self.part, b, len(at), keys[at].tobytes(), counts[at].tobytes()) for b, at in grouped(_bucket(distinct))]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        names = ("part", "bucket", "n", "keys", "counts")
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)})

    def phrases(self, answers: dict[int, bytes]) -> pa.Table:
        """The words, and the phrases whose pairs can all be frequent, with what they count here."""
        n = len(self.ids)
        frequent = self._frequent_pairs(answers)
        out = [_counted(self.names, 0, pa.array([""] * len(self.names)), self.totals)]
        ok = self.weights > 0
        for size in range(1, LONGEST + 1):
            if size > 1:
                ok &= frequent[size - 2 : size - 2 + n]
                ok &= self.left >= size
            at = np.flatnonzero(ok).astype(np.int32)
            order, heads = _equal(self._names(size, at))
            sums = _sums(self.weights[at][order], heads)
            out.extend(self._rows(size, at[order[heads]], sums))
        return pa.concat_tables(out)

    def _frequent_pairs(self, answers: dict[int, bytes]) -> np.ndarray:
        """For each word, and some more places, whether the pair that it starts can be frequent."""
        frequent = np.zeros(len(self.ids) + LONGEST, bool)
        order, heads = _equal(self.keys)
        known = answered(answers, _bucket(self.keys[order[heads]]))
        pairs = np.flatnonzero(self.left >= 2).astype(np.int32)
        frequent[pairs[order]] = np.repeat(known, np.diff(np.append(heads, len(order))))
        return frequent

    def _names(self, size: int, at: np.ndarray) -> np.ndarray:
        """The identifiers of phrases, by their first words."""
        names = np.empty(len(at), np.uint64)
        for i in range(0, len(at), BLOCK_ROWS):
            own = at[i : i + BLOCK_ROWS]
            ids = self.ids[own]
            for k in range(1, size):
                ids = mix(ids, self.ids[own + k])
            names[i : i + BLOCK_ROWS] = mix(ids, self.seeds[self.code[own]])
        return names

    def _rows(self, size: int, first: np.ndarray, sums: np.ndarray) -> Iterator[pa.Table]:
        for i in range(0, len(first), BLOCK_ROWS):
            own = first[i : i + BLOCK_ROWS]
            begin = self.at[own]
            length = self.at[own + size] - 1 - begin
            ends = np.cumsum(length)
            data = self.raw[np.repeat(begin - (ends - length), length) + np.arange(ends[-1])]
            data[data == _NEXT] = _SPACE
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            phrases = pa.StringArray.from_buffers(len(own), pa.py_buffer(offsets), pa.py_buffer(data))
            yield _counted(self.names.take(pa.array(self.code[own])), size, phrases, sums[i : i + BLOCK_ROWS])


def _equal(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that has equal keys together, and the places in it where the keys change."""
    order = np.argsort(keys).astype(np.int32)
    new = np.ones(len(keys), bool)
    new[1:] = (ordered := keys[order])[1:] != ordered[:-1]
    return order, np.flatnonzero(new)


def _sums(values: np.ndarray, heads: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, heads, dtype=np.int64) if len(heads) else np.zeros(0, np.int64)


def _bucket(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(32)).astype(np.int32)


def _counted(langs: pa.Array, size: int, phrases: pa.Array, sums: np.ndarray) -> pa.Table:
    return pa.table({"lang": langs, "size": pa.array(np.full(len(sums), size, np.int32)), "phrase": phrases, "a": pa.array(sums)})


def _seed(name: str) -> int:
    return int.from_bytes(hashlib.md5(name.encode()).digest()[:8], "little")


def _frequent(requests: pa.Table, least: int) -> pa.Table:
    """For one bucket, a bit for each pair of each part: whether all its counts together reach ``least``."""
    sizes = requests["n"].to_numpy()
    keys = np.concatenate([np.frombuffer(k.as_buffer(), np.uint32) for k in requests["keys"]])
    counts = np.concatenate([np.frombuffer(c.as_buffer(), np.min_scalar_type(least)) for c in requests["counts"]])
    distinct, of = np.unique(keys, return_inverse=True)
    enough = (np.bincount(of, counts, len(distinct)) >= least)[of]
    parts = np.split(enough, np.cumsum(sizes)[:-1])
    return pa.table({
        "part": requests["part"].combine_chunks(), "step": pa.array(np.zeros(len(sizes), np.int32)),
        "bucket": requests["bucket"].combine_chunks(), "data": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary()),
    })
