"""Identifiers of byte strings and word runs, computed with numpy inside a task.

An identifier is 64 bits wide and depends on the content alone, so the same string has
the same identifier in every task.  Longer strings get theirs from two identifiers at
later offsets of shorter ones, which may overlap: ``wider(ids, w, v)`` names runs of v
items from those of w items, w <= v <= 2w.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.Generator(np.random.PCG64(20240131))
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.uint64(0xD6E8FEB86659FD93)
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
_BYTE[SPACES] = 0


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One identifier of two, which depends on their order."""
    x = a * _STEP
    x ^= x >> np.uint64(29)
    x += b
    x *= _LAST
    x ^= x >> np.uint64(32)
    return x


def wider(ids: np.ndarray, width: int, to: int) -> np.ndarray:
    """Identifiers of runs of ``to`` items from those of ``width`` items."""
    shift = to - width
    return mix(ids[: max(0, len(ids) - shift)], ids[shift:])


def eights(data: np.ndarray, start: int, stop: int) -> np.ndarray:
    """The eight bytes from each position of [start, stop) on; needs stop + 7 <= len(data)."""
    return np.ndarray((max(0, stop - start),), "<u8", data, start, (1,)).copy()


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over every run of ``width`` values."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def words_of(data: np.ndarray, starts: np.ndarray, block: int = 1 << 18):
    """Words (runs without white space) of texts that lie one after the other.

    ``starts`` has the first byte of each text and, at its end, the length of all.
    Returns first byte, end and identifier of each word, and the number of words of
    each text.
    """
    n = len(data)
    space = SPACES[data]
    begins = ~space
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    begins[1:] &= space[:-1] | edge[1:n]
    at = np.flatnonzero(begins)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(starts) - 1, np.int64)
    stops = space.copy()
    stops |= edge[:n]
    ends_at = np.append(np.flatnonzero(stops), n)
    ends = ends_at[np.searchsorted(ends_at, at, side="right")]
    longest = int((ends - at).max())
    power = np.cumprod(np.full(longest + 1, 0xFF51AFD7ED558CCD, np.uint64))
    ids = np.empty(len(at), np.uint64)
    done = 0
    while done < len(at):
        last = max(done + 1, int(np.searchsorted(at, at[done] + block)))
        lo, hi = at[done], ends[last - 1]
        first = at[done:last] - lo
        offset = np.arange(hi - lo, dtype=np.int64)
        offset -= np.repeat(first, np.diff(np.append(first, hi - lo)))
        np.minimum(offset, longest, out=offset)
        ids[done:last] = np.add.reduceat(_BYTE[data[lo:hi]] * power[offset], first)
        done = last
    ids = mix(ids, (ends - at).astype(np.uint64))
    return at, ends, ids, np.diff(np.searchsorted(at, starts))
