"""Periodic runs of words, by longest common extensions in suffix trees.

A run is a stretch of words with a smallest period that no neighbouring word continues.
Every run has a Lyndon root, the longest Lyndon word that starts somewhere in it for one
of the two orders of the words.  So for each word and each order the longest Lyndon word
that starts there (up to the next smaller suffix) is a candidate, which is extended to
the right in the suffix tree of the words and to the left in that of their reversal.

Trees are built of what can hold a run only: if a run has ``least`` words and ``times``
periods or more, then all its words lie in windows of ``least - least // times`` words that
the document has more than once.  Stretches that such windows cover are found by their
identifiers, and a run, with all that could extend it, lies in one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .identifiers import mix, wider, words_of
from .suffix_tree import SuffixTree
from .texts import pieces, with_row

LEAST = 24
TIMES = 3


def find_runs(df: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Add ``n_words``, ``runs`` and ``collapsed`` to each row.

    Words are runs of other than the six ASCII white space characters.  ``runs`` are the
    maximal stretches of ``max(least, times * period)`` words or more, as (start, length,
    period) with words numbered from 0, in that order.  ``collapsed`` is the text without
    the words that a run has after its first period, joined by one space.

    Null and empty texts have no words, no runs and an empty ``collapsed``.  The results
    replace columns of their own names; other columns stay.  Rows are looked at one by
    one, without a shuffle; repeated rows have equal results.
    """
    names = ["n_words", "runs", "collapsed"]
    kept = [c for c in df.columns if c not in names]
    packed = df.select(
        F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.lit(0).alias("_")).alias("row"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"),
    )
    run = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, starts in pieces(batch):
                counts, found = runs_of_texts(data, starts, least, times)
                runs, collapsed = [], []
                for k, value in enumerate(rows["text"]):
                    words = value.as_py().split()
                    own = found.get(k, [])
                    runs.append([{"start": a, "length": b, "period": c} for a, b, c in own])
                    if own:
                        gone = np.zeros(len(words), bool)
                        for start, length, period in own:
                            gone[start + period : start + length] = True
                        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    collapsed.append(b" ".join(words))
                yield pa.record_batch({
                    "row": rows["row"], "n_words": pa.array(counts, pa.int64()), "runs": pa.array(runs, pa.list_(run)),
                    "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string()),
                })

    result = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    out = packed.mapInArrow(search, with_row(packed, result))
    return out.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(kept)], *names)


def runs_of_texts(data: np.ndarray, starts: np.ndarray, least: int, times: int):
    """Numbers of words, and the sorted runs of each text that has any."""
    _, _, ids, counts = words_of(data, starts)
    ends = np.cumsum(counts)
    found: dict[int, list[tuple[int, int, int]]] = {}
    for row, first, last in repetitive(ids, counts, least - least // times):
        if last - first >= least:
            base = first - (ends[row] - counts[row])
            own = runs_of(ids[first:last], least, times)
            found.setdefault(row, []).extend((s + base, n, p) for s, n, p in own)
    return counts, {row: sorted(runs) for row, runs in found.items()}


def repetitive(ids: np.ndarray, counts: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(row, first, last) of the stretches covered by windows of ``width`` words that their row has more than once."""
    if len(ids) <= width:
        return []
    have, windows = 1, ids
    while have < width:
        step = min(2 * have, width)
        windows, have = wider(windows, have, step), step
    row = np.repeat(np.arange(len(counts)), counts)[: len(windows)]
    fits = np.cumsum(counts)[row] - np.arange(len(windows)) >= width
    at = np.flatnonzero(fits)
    named = mix(windows[at], row[at].astype(np.uint64))
    order = np.argsort(named, kind="stable")
    same = named[order][1:] == named[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    at = at[again]
    if not len(at):
        return []
    cut = np.flatnonzero((at[1:] > at[:-1] + width) | (row[at[1:]] != row[at[:-1]])) + 1
    first, last = at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])] + width
    return list(zip(row[first].tolist(), first.tolist(), last.tolist(), strict=True))


def runs_of(ids: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of one sequence, sorted."""
    names, items = np.unique(ids, return_inverse=True)
    items = items + 1
    n = len(items)
    tree = SuffixTree(items)
    at, period = [], []
    for descending in (False, True):
        length = lyndon_lengths(tree.ranks(descending))
        few = np.flatnonzero(times * length <= n)
        at.append(few)
        period.append(length[few])
    at, period = np.concatenate(at), np.concatenate(period)
    right = tree.extension(at, at + period)
    # The first root in a run starts within its first period, so this much of the run is to the right of it.
    enough = right + 2 * period - 1 >= np.maximum(least, times * period)
    at, period, right = at[enough], period[enough], right[enough]
    if not len(at):
        return []
    reverse = SuffixTree(items[::-1])
    left = reverse.extension(n - at - period, n - at)
    start, length = at - left, left + period + right
    long = length >= np.maximum(least, times * period)
    runs = np.unique(np.stack([start[long], length[long], period[long]], axis=1), axis=0)
    return list(map(tuple, runs.tolist()))


def lyndon_lengths(ranks: np.ndarray) -> np.ndarray:
    """For each suffix but the empty one, how far it is to the next smaller one: the longest Lyndon word that starts there."""
    ranks = ranks.tolist()
    n = len(ranks) - 1
    following = [n] * n
    open_: list[int] = []
    for i, rank in enumerate(ranks):
        while open_ and ranks[open_[-1]] > rank:
            following[open_.pop()] = i
        open_.append(i)
    return np.array(following, np.int64) - np.arange(n)
