"""Byte-level BPE as Spark higher-order functions over the distinct words of blocks of documents.

A text is split by the pattern of the vocabulary, and distinct words are encoded.  The
most frequent words, up to ``FREQUENT``, are encoded once and sent to all
tasks.  For the others, tasks glue the documents they read into blocks of a few MB and
list the distinct words of each, so a word is encoded once a block however often it
occurs there.  A word is an array of its bytes; a fold over it merges
the two neighbours of the lowest rank until none are left that have one.  The ranks are
a constant: an array of small maps, chosen by the checksum of the bytes looked up, as a
single map would be searched from its start.  Decoding takes the bytes of each id from a
constant array and concatenates them.  Constants are rows of the shared folder, read as
scalar subqueries.

Only counts of words are shuffled.  A row is encoded in the task that reads it, and a
block holds the words of ``BLOCK`` bytes of texts or of one longer row.  A task has two
Python steps at work: the first is sent the frequent words, the second only their ids.
"""

from __future__ import annotations

import base64
import contextlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import let
from ..session import materialize
from .merges import merge_ranked
from .texts import with_row

BLOCK = 4 << 20
# Words that are sent to all tasks with their ids: no more than so many of ``FOLDED`` bytes.
FREQUENT = 3 << 18
# Maps of the constants: a few keys each.
PAIR_MAPS, WORD_MAPS, BYTE_MAPS = 1 << 15, 1 << 14, 1 << 8
# Words of more bytes are merged in the second Python step with a heap, as each step of
# the fold looks at the whole word, which is quadratic in its length.
FOLDED = 128
# More than a word of ``FOLDED`` bytes has places; a power of two.
PLACES = 256
_END = "\x00"  # says that no pair of a word is left; the characters of ids start after it

# Letters and numbers that Unicode has since version 13, which the pattern
# means, too, whatever the version that the Java runtime knows.
NEW_LETTERS = [
    (0x870, 0x887), (0x889, 0x88E), (0x8B5, 0x8B5), (0x8C8, 0x8C9), (0xC5D, 0xC5D), (0xCDD, 0xCDD), (0x170D, 0x170D),
    (0x171F, 0x171F), (0x1B4C, 0x1B4C), (0x1C89, 0x1C8A), (0x2C2F, 0x2C2F), (0x2C5F, 0x2C5F), (0x9FFD, 0x9FFF),
    (0xA7C0, 0xA7C1), (0xA7CB, 0xA7CD), (0xA7D0, 0xA7D1), (0xA7D3, 0xA7D3), (0xA7D5, 0xA7DC), (0xA7F2, 0xA7F4),
    (0x10570, 0x1057A), (0x1057C, 0x1058A), (0x1058C, 0x10592), (0x10594, 0x10595), (0x10597, 0x105A1),
    (0x105A3, 0x105B1), (0x105B3, 0x105B9), (0x105BB, 0x105BC), (0x105C0, 0x105F3), (0x10780, 0x10785),
    (0x10787, 0x107B0), (0x107B2, 0x107BA), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x10F70, 0x10F81), (0x11071, 0x11072), (0x11075, 0x11075), (0x1123F, 0x11240), (0x11380, 0x11389),
    (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1),
    (0x113D3, 0x113D3), (0x11740, 0x11746), (0x11AB0, 0x11ABF), (0x11BC0, 0x11BE0), (0x11F02, 0x11F02),
    (0x11F04, 0x11F10), (0x11F12, 0x11F33), (0x12F90, 0x12FF0), (0x1342F, 0x1342F), (0x13441, 0x13446),
    (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16A70, 0x16ABE), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF),
    (0x1AFF0, 0x1AFF3), (0x1AFF5, 0x1AFFB), (0x1AFFD, 0x1AFFE), (0x1B11F, 0x1B122), (0x1B132, 0x1B132),
    (0x1B155, 0x1B155), (0x1DF00, 0x1DF1E), (0x1DF25, 0x1DF2A), (0x1E030, 0x1E06D), (0x1E290, 0x1E2AD),
    (0x1E4D0, 0x1E4EB), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0), (0x1E7E0, 0x1E7E6), (0x1E7E8, 0x1E7EB),
    (0x1E7ED, 0x1E7EE), (0x1E7F0, 0x1E7FE), (0x2A6DE, 0x2A6DF), (0x2B735, 0x2B739), (0x2EBF0, 0x2EE5D),
    (0x31350, 0x323AF),
]
NEW_NUMBERS = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x11F50, 0x11F59), (0x16130, 0x16139),
    (0x16AC0, 0x16AC9), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1D2C0, 0x1D2D3), (0x1E4F0, 0x1E4F9),
    (0x1E5F1, 0x1E5FA),
]
SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _also(ranges: list[tuple[int, int]]) -> str:
    """A nested class of the ranges, entered only by characters between the first and the last of them."""
    inner = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges)
    return rf"[\x{{{ranges[0][0]:X}}}-\x{{{ranges[-1][1]:X}}}&&[{inner}]]"


def java_pattern(pattern: str) -> str:
    """A pattern of a rank file as a Java regular expression with the same classes."""
    spaces, letters, numbers = f"{SPACE}", r"\p{L}" + _also(NEW_LETTERS), r"\p{N}" + _also(NEW_NUMBERS)
    out, inside, i = [], False, 0
    while i < len(pattern):
        for name, members in ((r"\s", spaces), (r"\p{L}", letters), (r"\p{N}", numbers)):
            if pattern.startswith(name, i):
                out.append(members if inside else f"[{members}]")
                i += len(name)
                break
        else:
            if pattern.startswith(r"\S", i):
                out.append(f"[^{spaces}]")
                i += 2
            else:
                inside = pattern[i] == "[" or inside and pattern[i] != "]"
                out.append(pattern[i])
                i += 1
    return "".join(out)


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file and their ranks, which are their ids."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def _sign(i: int) -> str:
    """The character that stands for an id while a word is folded; surrogates are no characters."""
    return chr(i + 1 if i < 0xD7FF else i + 0x801)


def pair_ranks(ranks: dict[bytes, int]) -> dict[str, int]:
    """For two neighbouring ids, as their characters, the rank of their bytes together; pairs without one are left out."""
    pairs = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                pairs[_sign(a) + _sign(b)] = rank
    return pairs


def _constant(spark: SparkSession, value, kind: pa.DataType, cast: str | None = None) -> Column:
    """A value as a scalar subquery over a table of one row, cast to another type before it is written.

    As a literal it would be written out in the text of each plan it is in, which the
    session keeps, and be shipped with each stage as an object for each of its entries.
    """
    row = spark.createDataFrame(pa.table({"value": pa.array([value], kind)}))
    return materialize(row.select(F.col("value").cast(cast)) if cast else row, "constant").scalar()


def _vocabulary(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    """The vocabulary as one constant.

    ``pairs``, ``words`` and ``bytes`` are arrays of maps, each key in the map that its
    checksum chooses, as a single map would be searched from its start: the ids of pairs
    of characters, times ``PLACES``, of whole tokens that are text, and the characters of
    single bytes by their digits.  ``signs`` has the character of each id.
    """

    def dealt(entries: dict, count: int) -> list[list[tuple]]:
        maps: list[list[tuple]] = [[] for _ in range(count)]
        for key, value in entries.items():
            maps[zlib.crc32(key.encode()) % count].append((key, value))
        return maps

    words = {}
    for token, rank in ranks.items():
        with contextlib.suppress(UnicodeDecodeError):
            words[token.decode()] = rank
    bytes_ = {token.hex().upper(): _sign(rank) for token, rank in ranks.items() if len(token) == 1}
    value = {
        "pairs": dealt({pair: rank * PLACES for pair, rank in pair_ranks(ranks).items()}, PAIR_MAPS), "words": dealt(words, WORD_MAPS), "bytes": dealt(bytes_, BYTE_MAPS),
        "signs": [_sign(i) for i in range(max(ranks.values()) + 1)],
    }
    longs, numbers, signs = (pa.list_(pa.map_(pa.string(), t)) for t in (pa.int64(), pa.int32(), pa.string()))
    kind = pa.struct({"pairs": longs, "words": numbers, "bytes": signs, "signs": pa.list_(pa.string())})
    return _constant(spark, value, kind)


def _looked_up(table: dict[str, Column], name: str, key: Column) -> Column:
    mask = {"pairs": PAIR_MAPS, "words": WORD_MAPS, "bytes": BYTE_MAPS}[name] - 1
    return F.try_element_at(F.get(table[name], F.crc32(key.cast("binary")).bitwiseAND(mask).cast("int")), key)


def _unpacked(table: Column, body: Callable[[dict[str, Column]], Column]) -> Column:
    """The body over the fields of the vocabulary; that of pairs, which most lookups need, is taken out once."""
    names = ("words", "bytes", "signs")
    return let(table, lambda t: let(t["pairs"], lambda pairs: body({"pairs": pairs} | {name: t[name] for name in names})))


def folded(word: Column, table: dict[str, Column]) -> Column:
    """The ids of one word: its own, or those that ranked merges of its bytes leave.

    The array of bytes is written with a character for each id, so a merge overlays two
    characters by that of their bytes together, whose id is the rank.  Each step of the
    fold merges the leftmost pair of the lowest rank, which is the least sum of rank, times
    ``PLACES``, and place.
    """

    def sign(i: Column) -> Column:
        return F.get(table["signs"], i)

    def places(n: Column) -> Column:
        return F.sequence(F.lit(1), n)

    def step(signs: Column, _: Column) -> Column:
        def merged(least: Column) -> Column:
            at = least.bitwiseAND(PLACES - 1).cast("int")
            rank = F.shiftright(least, PLACES.bit_length() - 1).cast("int")
            return F.when(least.isNull(), F.concat(signs, F.lit(_END))).otherwise(F.overlay(signs, sign(rank), at, F.lit(2)))

        pairs = F.transform(
            places(F.greatest(F.char_length(signs) - 1, F.lit(1))),
            lambda i: _looked_up(table, "pairs", F.substring(signs, i, F.lit(2))) + i,
        )
        return F.when(F.endswith(signs, F.lit(_END)), signs).otherwise(let(F.array_min(pairs), merged))

    def merges(n: Column) -> Column:
        digits = F.hex(word.cast("binary"))
        start = let(digits, lambda d: F.array_join(F.transform(
            places(n), lambda i: _looked_up(table, "bytes", F.substring(d, 2 * i - 1, F.lit(2)))), ""))

        def ids(signs: Column) -> Column:
            points = F.transform(places(F.char_length(signs)), lambda i: F.ascii(F.substring(signs, i, F.lit(1))))
            return F.transform(points, lambda c: F.when(c < 0xD800, c - 1).otherwise(c - 0x801))

        end = F.aggregate(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), start, step)
        return let(F.rtrim(end, F.lit(_END)), ids)

    def encoded(own: Column) -> Column:
        return F.when(own.isNotNull(), F.array(own)).otherwise(let(F.octet_length(word), merges))

    return F.when(F.octet_length(word) <= FOLDED, let(_looked_up(table, "words", word), encoded))


def encode(
    df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", packed: str = "packed_ids",
    keep: list[str] | None = None,
) -> DataFrame:
    """Add the token ids of each text, as an array and as little-endian unsigned 32-bit integers.

    ``path`` is a file of ranks, read by the driver, and ``pattern`` what splits a text
    before the merges.  Special tokens are not known: their strings are ordinary text.
    A null text counts as empty and an empty one has no ids.  ``keep`` names the columns
    to return besides (all of the input by default); results replace columns of their
    own names.  Repeated rows have equal results; an empty table gives an empty result.
    """
    ranks = read_ranks(path)
    sent = df.sparkSession.sparkContext.broadcast(ranks)  # the vocabulary file, whatever the data
    kept = [c for c in (df.columns if keep is None else keep) if c not in (ids, packed)]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words = F.regexp_extract_all(whole, F.lit(java_pattern(pattern)), F.lit(0))
    rows = df.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.lit(0).alias("_")).alias("row"),
                     F.octet_length(whole).alias("size"), words.alias("words"))
    schema = StructType.fromDDL("rows array<struct<x:int>>, sizes array<int>, at array<int>, words array<string>")
    schema["rows"].dataType.elementType = rows.schema["row"].dataType
    table = _vocabulary(df.sparkSession, ranks)
    known = _frequent(rows.select("words"), table)
    # Each for the one step that needs it, as a worker holds all that it is sent.
    frequent, frequent_ids = (df.sparkSession.sparkContext.broadcast(known[c].combine_chunks()) for c in ("word", "ids"))
    del known

    def glue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _blocks(batches, frequent.value)

    def fold(table: dict[str, Column]) -> Column:
        return F.transform("words", lambda w: folded(w, table))

    long_words = F.filter("words", lambda w: F.octet_length(w) > FOLDED)
    coded = rows.mapInArrow(glue, schema).withColumn("table", table).select(
        "rows", "sizes", "at", long_words.alias("long_words"), _unpacked(F.col("table"), fold).alias("coded")
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _applied(batches, sent, frequent_ids.value)

    out = coded.mapInArrow(apply, with_row(rows, "ids array<int>, packed binary"))
    return out.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(kept)], F.col("ids").alias(ids),
                      F.col("packed").alias(packed))


def _frequent(rows: DataFrame, table: Column) -> pa.Table:
    """The most frequent words, with their ids: as many as ``FREQUENT`` allows, by the logarithm of their counts."""
    words = rows.mapInArrow(_counted, "word string, c long").filter(F.octet_length("word") <= FOLDED)
    counts = words.groupBy("word").agg(F.sum("c").alias("c")).filter("c > 1")
    counts = materialize(counts.select("word", F.floor(8 * F.log2("c")).cast("int").alias("scale")), "words")
    total, least = 0, 2**31 - 1
    for scale, n in sorted(map(tuple, counts.groupBy("scale").count().collect()), reverse=True):  # 8 rows for each power of 2
        total += n
        if total > FREQUENT:
            break
        least = scale
    chosen = counts.filter(F.col("scale") >= least).withColumn("table", table)
    return chosen.select("word", _unpacked(F.col("table"), lambda t: folded(F.col("word"), t)).alias("ids")).toArrow()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each batch with their counts."""
    for batch in batches:
        found = pc.value_counts(batch["words"].flatten())
        yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "c"])


def _blocks(batches: Iterator[pa.RecordBatch], known: pa.Array) -> Iterator[pa.RecordBatch]:
    """One row per block: its rows, their numbers of words, each word's place in a list of words, and that list.

    The list is that of the known words, which is left out, and then the others of the block.
    The known words are looked for among those of the block, whose table is small, not the
    other way round.
    """
    for batch in batches:
        words = batch["words"]
        sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        flat = words.flatten()
        ends, size = (np.concatenate([[0], np.cumsum(n, dtype=np.int64)]) for n in (sizes, batch["size"].to_numpy()))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(size, size[start] + BLOCK, side="right")) - 1)
            own = flat.slice(ends[start], ends[stop] - ends[start]).dictionary_encode()
            found = pc.index_in(known, value_set=own.dictionary)
            both = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
            place = np.full(len(own.dictionary), -1, np.int32)
            place[found.drop_null().to_numpy()] = both
            new = np.flatnonzero(place < 0)
            place[new] = len(known) + np.arange(len(new))
            at = pa.array(place[own.indices.to_numpy()], pa.int32())
            columns = [batch["row"].slice(start, stop - start), pa.array(sizes[start:stop], pa.int32()), at, own.dictionary.take(pa.array(new))]
            del own, found, both, place, new, at
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns],
                names=["rows", "sizes", "at", "words"],
            )
            del columns
            pa.default_memory_pool().release_unused()
            start = stop


def _applied(batches: Iterator[pa.RecordBatch], sent, known: pa.Array) -> Iterator[pa.RecordBatch]:
    """The rows of blocks with their ids, put together from those of the known words and of the block's others."""
    # Ids of a block have 32-bit offsets anyway, as lists of Arrow.
    lengths = np.array(pc.list_value_length(known), np.int32)
    starts = np.cumsum(lengths, dtype=np.int32) - lengths
    tokens = np.array(known.flatten(), np.int32)
    words, known_ids = len(lengths), len(tokens)
    for batch in batches:
        for i in range(batch.num_rows):
            rows, sizes, at, long_words, coded = (batch[c][i].values for c in ("rows", "sizes", "at", "long_words", "coded"))
            missing = np.flatnonzero(coded.is_null().to_numpy(zero_copy_only=False)).tolist()
            for word, text in zip(missing, long_words.to_pylist(), strict=True):
                merged = _by_heap(text.encode(), sent.value)
                coded = pa.concat_arrays([coded.slice(0, word), pa.array([merged], coded.type), coded.slice(word + 1)])
            own = pc.list_value_length(coded).to_numpy(zero_copy_only=False)
            lengths, starts = _put(lengths, words, own), _put(starts, words, known_ids + np.cumsum(own, dtype=np.int32) - own)
            tokens = _put(tokens, known_ids, coded.flatten().to_numpy(zero_copy_only=False))
            at = at.to_numpy(zero_copy_only=False)
            each = lengths[at]
            ends = np.cumsum(each, dtype=np.int32)
            place = np.repeat(starts[at] - (ends - each), each)
            place += np.arange(len(place), dtype=np.int32)
            ids = tokens[place]
            per_row = np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)])
            edges = np.concatenate([[0], ends])[per_row].astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(edges * 4), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays([rows, pa.ListArray.from_arrays(edges, ids), packed], names=["row", "ids", "packed"])
            del rows, sizes, at, long_words, coded, each, ends, place, ids, packed
            pa.default_memory_pool().release_unused()


def _put(array: np.ndarray, first: int, values: np.ndarray) -> np.ndarray:
    """The array with the values from a place on; it is copied only if there is no room."""
    if first + len(values) > len(array):
        array = np.concatenate([array[:first], np.empty(2 * len(values), array.dtype)])
    array[first : first + len(values)] = values
    return array


def _by_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    if word in ranks:
        return [ranks[word]]
    parts = merge_ranked([word[i : i + 1] for i in range(len(word))], lambda a, b: ranks.get(a + b))
    return [ranks[p] for p in parts]


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the bytes that an array of ids decodes to: those of its tokens, concatenated.

    A null or empty array gives no bytes; an id that the vocabulary does not have is an
    error.  One token's bytes need not be whole characters, so the result is binary.
    """
    ranks = read_ranks(path)
    pieces: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    # A cast of bytes to a string keeps them as they are, and only strings can be joined in one go.
    constant = _constant(df.sparkSession, pieces, pa.list_(pa.binary()), "array<string>")

    def joined(table: Column) -> Column:
        def piece(i: Column) -> Column:
            unknown = F.raise_error(F.concat(F.lit("no token has the id "), i.cast("string")))
            return F.coalesce(F.get(table, i), unknown.cast("string"))

        return F.array_join(F.transform(F.coalesce(F.col(f"`{ids}`"), F.array().cast("array<int>")), piece), "").cast("binary")

    table = "_" * (1 + max(map(len, df.columns)))  # no column of the input
    return df.withColumn(table, constant).withColumn(decoded, let(F.col(table), joined)).drop(table)
