"""Removal of byte strings that occur before, by bucket-pointer refinement of suffixes.

The suffixes of all texts are put into buckets by their first 32 bytes, and buckets of
one suffix are dropped.  The others are refined: the identifier of the bucket for the
first 2k bytes is made of the identifiers that the suffixes at this and a later offset
have for k bytes, each level reusing the one below (8, 16, 32, 64, 100 bytes).  Sorting
on the last identifiers gives the classes of equal strings and the first member of each.

Two points make that fit a cluster.  Identifiers are hashes of the content instead of
ranks, so no task needs the others' buckets.  And the first buckets are not made of
every suffix but of those that any two equal strings of 100 bytes have in common: in
each such string the 32-byte run with the least identifier.  A suffix next to it is
refined only if that one is in a bucket of several.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .exchange import Anchors, Chunk, Occurrences, spread
from .first_windows import first_windows
from .identifiers import eights, mix, sliding, wider

LENGTH = 100
PREFIX = 32
REACH = LENGTH - PREFIX  # a string's prefixes start at offsets 0 to REACH
BLOCK = 1 << 16
_NONE = np.uint32(0xFFFFFFFF)


def remove_repeated_strings(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove each byte covered by a 100-byte string that also starts earlier.

    Earlier is in a document with a smaller id, or in the same document at an earlier
    byte, overlapping or not; strings never cross documents and are judged on the
    input.  Returns the columns of the input but the text in a struct ``row``, and
    ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept`` (the
    remaining bytes) and ``kept_text`` (those as text, without characters that lost
    some of their bytes; null for a null text).

    A null text counts as empty.  Rows without an id come after all others.  Rows that
    share an id are different documents of which none is before the other, so repeated
    rows have equal results.  An empty table gives an empty result.
    """
    result = "n_bytes long, n_removed long, n_spans long, kept binary, kept_text string"
    return first_windows(df, id_column, text, _ask_anchors, _ask_windows, _verdict, result)


class _Bytes:
    """The bytes of the documents that are no copies and long enough."""

    def __init__(self, chunk: Chunk):
        self.rows = np.flatnonzero(~chunk.copy & (np.diff(chunk.starts) >= LENGTH))
        self.data, self.starts = chunk.only(self.rows)

    def _fits(self, length: int) -> np.ndarray:
        """Whether a string of this length from a position on ends in the document."""
        fits = np.ones(len(self.data), bool)
        fits[(self.starts[1:, None] - np.arange(1, length)).ravel()] = False
        return fits

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Position and identifier of the runs that are the least of some string."""
        n = len(self.data)
        fits = self._fits(PREFIX)
        at, ids = [], []
        for start in range(0, n - PREFIX + 1, BLOCK):
            lo, hi = max(0, start - REACH), min(n - PREFIX + 1, start + BLOCK + REACH)
            eight = eights(self.data, lo, hi + PREFIX - 8)
            full = wider(wider(eight, 8, 16), 16, 32)
            rank = (full >> np.uint64(32)).astype(np.uint32)
            rank[~fits[lo:hi]] = _NONE
            least = sliding(rank, REACH + 1, np.minimum)
            none = np.zeros(REACH, np.uint32)
            most = sliding(np.concatenate([none, least, none]), REACH + 1, np.maximum)
            chosen = np.flatnonzero((most == rank) & (rank != _NONE)) + lo
            chosen = chosen[(chosen >= start) & (chosen < start + BLOCK)]
            at.append(chosen)
            ids.append(full[chosen - lo])
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(at), np.concatenate(ids)

    def windows(self, at: np.ndarray, ids: np.ndarray, shared: np.ndarray, buckets: int, chunk: Chunk):
        """Starts of the strings whose least run is in a bucket of several, and their occurrences."""
        n = len(self.data)
        rank = (ids >> np.uint64(32)).astype(np.uint32)
        first, last = at - REACH, at.copy()
        step = 1
        while step < len(at):
            near = at[step:] - at[:-step] <= REACH
            if not near.any():
                break
            less = near & (rank[:-step] < rank[step:])
            first[step:][less] = np.maximum(first[step:], at[:-step] + 1)[less]
            more = near & (rank[step:] < rank[:-step])
            last[:-step][more] = np.minimum(last[:-step], at[step:] - REACH - 1)[more]
            step += 1
        held = shared & (first <= last) & (last >= 0)
        chosen = spread(n, np.maximum(first[held], 0), last[held] + 1) if n else np.zeros(0, bool)
        chosen &= self._fits(LENGTH)
        where, names, second = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for start in range(0, n - LENGTH + 1, BLOCK):
            stop = min(start + BLOCK, n - LENGTH + 1)
            own = np.flatnonzero(chosen[start:stop])
            if not len(own):
                continue
            eight = eights(self.data, start, stop + LENGTH - 8)
            half = wider(wider(wider(eight, 8, 16), 16, 32), 32, 64)
            a, b = half[own], half[own + LENGTH - 64]
            where.append(own + start)
            names.append(mix(a, b))
            second.append(mix(b, a))
        where = np.concatenate(where)
        row = np.searchsorted(self.starts, where, side="right") - 1
        return where, Occurrences(np.concatenate(names), np.concatenate(second), self.rows[row], chunk.keys, buckets)


def _ask_anchors(chunk: Chunk, buckets: int) -> pa.Table:
    return Anchors(_Bytes(chunk).anchors()[1], buckets).ask(chunk.chunk)


def _windows(chunk: Chunk, buckets: int):
    own = _Bytes(chunk)
    at, ids = own.anchors()
    return own, *own.windows(at, ids, Anchors(ids, buckets).shared(chunk.answers[1]), buckets, chunk)


def _ask_windows(chunk: Chunk, buckets: int) -> pa.Table:
    return _windows(chunk, buckets)[2].ask(chunk.chunk)


def _verdict(chunk: Chunk, buckets: int) -> pa.Table:
    own, at, windows = _windows(chunk, buckets)
    later = at[windows.later(chunk.answers[2], within=True)]
    gone = spread(len(own.data), later, later + LENGTH)
    place = dict(zip(own.rows.tolist(), zip(own.starts[:-1].tolist(), own.starts[1:].tolist(), strict=True), strict=True))
    sizes, removed, spans, kept, texts = [], [], [], [], []
    absent = chunk.table["absent"].to_pylist()
    for row, (text, copy) in enumerate(zip(chunk.table["text"], chunk.copy.tolist(), strict=True)):
        data = text.as_py()
        mask = gone[slice(*place[row])] if row in place else None
        runs = cut = 0
        sizes.append(len(data))
        if copy and len(data) >= LENGTH:
            runs, cut, data = 1, len(data), b""
        elif mask is not None and mask.any():
            runs = int(mask[0]) + int(np.count_nonzero(mask[1:] & ~mask[:-1]))
            cut = int(np.count_nonzero(mask))
            data = np.frombuffer(data, np.uint8)[~mask].tobytes()
        removed.append(cut)
        spans.append(runs)
        kept.append(data)
        texts.append(None if absent[row] else data.decode("utf-8", "ignore"))
    numbers = {"n_bytes": sizes, "n_removed": removed, "n_spans": spans}
    return pa.table({
        **{k: pa.array(v, pa.int64()) for k, v in numbers.items()},
        "kept": pa.array(kept, pa.binary()),
        "kept_text": pa.array(texts, pa.string()),
    })
