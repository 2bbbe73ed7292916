"""Removal of word windows that an earlier document has, found by difference-cover anchors.

Of each document only the 7-word runs that start at a cover position modulo 7 are hashed.
The cover {0, 1, 3} has every difference modulo 7, so two equal windows of 13 words,
wherever they start, have cover positions at one common offset below 7, and the runs
there are equal.  Runs that occur once in the table are dropped; the windows around the
others are extended to their 13 words and compared as a whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .exchange import Anchors, Chunk, Occurrences, spread
from .first_windows import first_windows
from .identifiers import wider, words_of

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)


def remove_repeated_windows(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove each word covered by a 13-word window that a document with a smaller id has, too.

    Words are runs of other than the six ASCII white space characters.  Windows are
    judged on the input, not on what is left.  Returns the columns of the input but
    the text in a struct ``row``, and ``n_words``, ``n_removed`` and ``kept_text`` (the
    other words, unchanged, joined by one space).

    Null and empty texts have no words, and ``kept_text`` is empty.  Rows without an id
    come after all others.  Rows that share an id are not before each other, so
    repeated rows have equal results.  An empty table gives an empty result.
    """
    result = "n_words long, n_removed long, kept_text string"
    return first_windows(df, id_column, text, _ask_anchors, _ask_windows, _verdict, result)


class _Words:
    """The words of the documents that are no copies and long enough for a window."""

    def __init__(self, chunk: Chunk):
        # A window has 13 characters and 12 spaces at least.
        self.rows = np.flatnonzero(~chunk.copy & (np.diff(chunk.starts) >= 2 * WINDOW - 1))
        data, starts = chunk.only(self.rows)
        _, _, self.ids, self.counts = words_of(data, starts)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        runs = wider(wider(wider(self.ids, 1, 2), 2, 4), 4, PERIOD)
        within = np.arange(len(runs)) - np.repeat(self.first[:-1], self.counts)[: len(runs)]
        left = np.repeat(self.counts, self.counts)[: len(runs)] - within
        at = np.flatnonzero(np.isin(within % PERIOD, COVER) & (left >= PERIOD))
        return at, runs[at]

    def windows(self, shared: np.ndarray, buckets: int, chunk: Chunk) -> tuple[np.ndarray, Occurrences]:
        """Starts of the windows around anchors, and their occurrences."""
        n = len(self.ids)
        at = np.flatnonzero(spread(n, np.maximum(shared - PERIOD + 1, 0), shared + 1))
        row = np.searchsorted(self.first, at, side="right") - 1
        fits = at + WINDOW <= self.first[row + 1]
        at, row = at[fits], row[fits]
        eight = wider(wider(wider(self.ids, 1, 2), 2, 4), 4, 8)
        ids = wider(eight, 8, WINDOW)[at] if len(at) else np.zeros(0, np.uint64)
        second = eight[at + WINDOW - 8] if len(at) else ids
        return at, Occurrences(ids, second ^ (ids << np.uint64(1)), self.rows[row], chunk.keys, buckets)


def _ask_anchors(chunk: Chunk, buckets: int) -> pa.Table:
    return Anchors(_Words(chunk).anchors()[1], buckets).ask(chunk.chunk)


def _windows(chunk: Chunk, buckets: int):
    words = _Words(chunk)
    at, runs = words.anchors()
    shared = at[Anchors(runs, buckets).shared(chunk.answers[1])]
    return words, *words.windows(shared, buckets, chunk)


def _ask_windows(chunk: Chunk, buckets: int) -> pa.Table:
    return _windows(chunk, buckets)[2].ask(chunk.chunk)


def _verdict(chunk: Chunk, buckets: int) -> pa.Table:
    words, at, windows = _windows(chunk, buckets)
    later = at[windows.later(chunk.answers[2], within=False)]
    gone = spread(len(words.ids), later, later + WINDOW)
    place = dict(zip(words.rows.tolist(), zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True), strict=True))
    counts, removed, kept = [], [], []
    for row, (text, copy) in enumerate(zip(chunk.table["text"], chunk.copy.tolist(), strict=True)):
        own = text.as_py().split()
        counts.append(len(own))
        if copy and len(own) >= WINDOW:
            removed.append(len(own))
            own = []
        elif row in place and (mask := gone[slice(*place[row])]).any():
            removed.append(int(mask.sum()))
            own = [w for w, m in zip(own, mask.tolist(), strict=True) if not m]
        else:
            removed.append(0)
        kept.append(b" ".join(own))
    return pa.table({
        "n_words": pa.array(counts, pa.int64()),
        "n_removed": pa.array(removed, pa.int64()),
        "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
    })
