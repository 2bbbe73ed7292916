"""Byte-pair encoding and decoding, with words cut where no token can span the cut.

The vocabulary is that of a tokenizers file whose model is BPE with word ends.  A pair
of neighbouring symbols that is inside no token of the vocabulary can never be merged
over, so a word falls into fragments that are encoded on their own; the encodings are
joined.  Fragments recur far more often than words, and so do words than texts: both
are kept in tables of a bounded size.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merges import merge_ranked
from .texts import slices, with_row

WORD_END = "</w>"
KEPT_WORDS = 300_000
KEPT_FRAGMENTS = 50_000
# Longer words are not kept, and longer fragments are merged with a heap.
KEPT_LENGTH = 256
SHORT = 64

# Characters for which this module splits and lowers text itself: Latin letters up to
# U+017F but one, whose classes and cases are the same in every version of Unicode, and
# general punctuation.  Other texts go through the tokenizers library.
_OTHER = re.compile("[^\x00-įı-ſ‐-‧‰-⁞]")
_LETTER = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
_DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = "\t-\r \x85\xa0"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^{_SPACE}{_LETTER}{_DIGIT}]+")


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Encoder(dict):
    """Words to their ids, as little-endian 32-bit integers."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_str(definition)
        spec = json.loads(definition)
        model = spec["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocabulary.items(), *self.special.items()]}
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.alphabet = _byte_alphabet()
        self.inside = {pair for t in map(_symbols, self.vocabulary) for pair in zip(t, t[1:], strict=False)}
        self.fragments: dict[tuple[str, ...], list[str]] = {}  # those that are not whole words

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        if len(self.fragments) >= KEPT_FRAGMENTS:
            self.fragments.clear()
        letters = "".join([self.alphabet[b] for b in word.encode()])
        symbols = (*letters[:-1], letters[-1] + WORD_END)
        parts, start = [], 0
        for i in range(1, len(symbols) + 1):
            if i == len(symbols) or (symbols[i - 1], symbols[i]) not in self.inside:
                fragment = symbols[start:i]
                done = self.fragments.get(fragment)
                if done is None:
                    done = self.merged(fragment)
                    if len(fragment) < min(len(symbols), KEPT_LENGTH):
                        self.fragments[fragment] = done
                parts += done
                start = i
        found = b"".join([self.vocabulary[p].to_bytes(4, "little") for p in parts])
        if len(symbols) <= KEPT_LENGTH:
            self[word] = found
        return found

    def merged(self, symbols: tuple[str, ...]) -> list[str]:
        """Merge the pair of the lowest rank, the leftmost first, until none is left."""
        rank = self.rank
        if len(symbols) > SHORT:
            return merge_ranked(symbols, lambda a, b: rank.get((a, b)))
        parts = list(symbols)
        while len(parts) > 1:
            best, at = None, 0
            for i, pair in enumerate(zip(parts, parts[1:], strict=False)):
                r = rank.get(pair)
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def words(self, text: str) -> list[str]:
        """What the normalizer and the splitter of the library leave of a text without special tokens."""
        if _OTHER.search(text) is None:
            return _WORDS.findall(text.lower())
        letters = {c: b for b, c in enumerate(self.alphabet)}
        split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes([letters[c] for c in piece]).decode() for piece, _ in split]

    def encode(self, text: str) -> bytes:
        """The ids of a text; strings of special tokens are those tokens."""
        found = []
        for part in self.cuts.split(text) if "<|" in text else (text,):
            if part in self.special:
                found.append(self.special[part].to_bytes(4, "little"))
            else:
                found += map(self.__getitem__, self.words(part))
        return b"".join(found)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _symbols(token: str) -> list[str]:
    if token.endswith(WORD_END) and token != WORD_END:
        letters = token[: -len(WORD_END)]
        return [*letters[:-1], letters[-1] + WORD_END]
    return list(token)


class _Shared:
    """A tokenizer's definition, sent to each executor once; it is a file of a few MB whatever the data."""

    def __init__(self, spark, path: str):
        with open(path, encoding="utf-8") as file:
            self.sent = spark.sparkContext.broadcast(file.read())

    def encoder(self) -> Encoder:
        return Encoder(self.sent.value)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the token ids of each text, and what they decode to.

    ``path`` is a tokenizers file with a BPE model with word ends, read by the driver.
    ``ids`` are little-endian unsigned 32-bit integers as bytes.  No special tokens are
    added; their strings in a text become those tokens.  ``decoded`` is the tokens
    joined by spaces, as the library decodes without a decoder, special ones included.
    A null text counts as empty; an empty one has no tokens and decodes to an empty
    text.  Other columns, whatever their names, stay as they are; the results replace
    columns of their own names.  Rows are encoded one by one, without a shuffle.
    """
    shared = _Shared(df.sparkSession, path)
    rest = [F.col(f"`{c}`") for c in df.columns]
    packed = df.select(F.struct(*rest).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.encoder()
        for batch in batches:
            for rows in slices(batch):
                found = [encoder.encode(t) for t in rows["text"].to_pylist()]
                yield pa.record_batch({
                    "row": rows["row"],
                    "ids": pa.array(found, pa.binary()),
                    "decoded": pa.array(map(encoder.decode, found), pa.string()),
                })
        encoder.clear()  # the worker process lives on

    out = packed.mapInArrow(run, with_row(packed, "ids binary, decoded string"))
    return out.select(*[F.col("row")[c].alias(c) for c in df.columns if c not in (ids, decoded)],
                      F.col("ids").alias(ids), F.col("decoded").alias(decoded))


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the text that token ids decode to: the tokens joined by spaces.

    A null or empty list of ids decodes to an empty text; an id that the vocabulary does
    not have is an error.
    """
    shared = _Shared(df.sparkSession, path)
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(ids).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.encoder()
        for batch in batches:
            texts = [encoder.decode(i or b"") for i in batch["ids"].to_pylist()]
            yield pa.record_batch({"row": batch["row"], "decoded": pa.array(texts, pa.string())})

    out = packed.mapInArrow(run, with_row(packed, "decoded string"))
    return out.select(*[F.col("row")[c].alias(c) for c in df.columns if c != decoded], F.col("decoded").alias(decoded))
