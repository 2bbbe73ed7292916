"""Ranked merges of one sequence of symbols in n log n steps."""

from __future__ import annotations

import heapq
from collections.abc import Callable


def merge_ranked(symbols, rank: Callable) -> list:
    """Merge the neighbours of the lowest rank, the leftmost first, until no pair has one.

    ``rank(a, b)`` is the rank of two neighbours or None.  The symbols are a linked list
    and the ranked pairs a heap; a pair that a merge has changed is skipped when it
    comes up, so each merge costs two new pairs whatever the length of the sequence.
    """
    parts = list(symbols)
    n = len(parts)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        r = rank(parts[i], parts[i + 1])
        if r is not None:
            heap.append((r, i, parts[i], parts[i + 1]))
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= n or parts[j] != b:
            continue
        parts[i], parts[j] = a + b, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            r = rank(parts[i], parts[k])
            if r is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[k]))
        h = before[i]
        if h >= 0:
            r = rank(parts[h], parts[i])
            if r is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
    return [p for p in parts if p is not None]
