"""Suffix trees of integer sequences, and longest common extensions by lowest common ancestors."""

from __future__ import annotations

import numpy as np

_BLOCK = 16


class SuffixTree:
    """The suffix tree of a sequence of positive integers, built from left to right as Ukkonen does.

    A 0, which is less than every item, ends the sequence, so that each suffix is a
    leaf.  The Euler tour visits children in ascending order; the depth of the lowest
    common ancestor of two leaves is the least depth between their visits, which blocks
    of the tour with a sparse table over them answer in constant time.
    """

    def __init__(self, items: np.ndarray):
        self.n = len(items)
        text = [*items.tolist(), 0]
        self._build(text)
        self._tour()

    def _build(self, text: list[int]) -> None:
        size, endless = max(text) + 1, len(text) + 1
        begin, length, link = [0], [0], [0]  # of the edge that leads to a node; the root is 0
        child: dict[int, int] = {}
        node = wait = 0  # of the current suffix ``wait`` items hang below ``node``
        for i, item in enumerate(text):
            wait += 1
            last = 0
            while wait:
                key = node * size + text[i + 1 - wait]
                below = child.get(key)
                if below is None:
                    child[key] = len(begin)
                    begin.append(i + 1 - wait)
                    length.append(endless)
                    link.append(0)
                    link[last] = node
                    last = 0
                elif wait > length[below]:
                    node = below
                    wait -= length[below]
                    continue
                else:
                    at = begin[below] + wait - 1
                    if text[at] == item:
                        link[last] = node
                        break
                    middle = len(begin)
                    begin += (begin[below], i)
                    length += (wait - 1, endless)
                    link += (0, 0)
                    child[key] = middle
                    child[middle * size + item] = middle + 1
                    child[middle * size + text[at]] = below
                    begin[below] = at
                    length[below] -= wait - 1
                    link[last] = last = middle
                link[0] = 0
                if node:
                    node = link[node]
                else:
                    wait -= 1
        begin, length = np.array(begin, np.int64), np.array(length, np.int64)
        self.leaf = length > len(text) - begin
        self.leaf[0] = False
        self.span = np.where(self.leaf, len(text) - begin, length)
        edges = np.fromiter(child.keys(), np.int64, len(child))
        nodes = np.fromiter(child.values(), np.int64, len(child))
        parents, firsts = edges // size, edges % size
        order = np.lexsort((firsts, parents))
        self.children = nodes[order]
        self.first_child = np.searchsorted(parents[order], np.arange(len(begin) + 1))

    def _tour(self) -> None:
        """Depths along the Euler tour, where each leaf is met, and the rank of each suffix."""
        children, ends, span, leaf = self.children.tolist(), self.first_child.tolist(), self.span.tolist(), self.leaf.tolist()
        following, depth = ends[:-1], [0] * len(span)
        suffixes, visits, depths = [], [], [0]
        path = [0]
        total = self.n + 1
        while path:
            node = path[-1]
            at = following[node]
            if at == ends[node + 1]:
                path.pop()
                if path:
                    depths.append(depth[path[-1]])
                continue
            following[node] = at + 1
            below = children[at]
            depth[below] = down = depth[node] + span[below]
            depths.append(down)
            if leaf[below]:
                suffixes.append(total - down)
                visits.append(len(depths) - 1)
                depths.append(depth[node])
            else:
                path.append(below)
        self.sorted = np.array(suffixes, np.int64)
        self.visit = np.empty(total, np.int64)
        self.visit[self.sorted] = visits
        depths = np.array(depths, np.int32)
        blocks = -(-len(depths) // _BLOCK)
        padded = np.full(blocks * _BLOCK, np.iinfo(np.int32).max, np.int32)
        padded[: len(depths)] = depths
        grid = padded.reshape(blocks, _BLOCK)
        self.depths = padded
        self.left = np.minimum.accumulate(grid, axis=1).ravel()  # from the block's start up to here
        self.right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [grid.min(axis=1)]
        width = 1
        while 2 * width <= blocks:
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def ranks(self, descending: bool = False) -> np.ndarray:
        """The place of each suffix in their order; with ``descending`` items count the other way round, but an end stays least."""
        if not descending:
            found = self.sorted
        else:
            children, ends, span, leaf = self.children.tolist(), self.first_child.tolist(), self.span.tolist(), self.leaf.tolist()
            total, found, todo = self.n + 1, [], [(0, 0)]
            while todo:
                node, depth = todo.pop()
                if leaf[node]:
                    found.append(total - depth)
                    continue
                own = children[ends[node] : ends[node + 1]]
                # The stack hands out the last first: an end, where there is one, and then the greatest item.
                if leaf[own[0]] and span[own[0]] == 1:
                    own = own[1:] + own[:1]
                todo += [(c, depth + span[c]) for c in own]
            found = np.array(found, np.int64)
        out = np.empty(self.n + 1, np.int64)
        out[found] = np.arange(self.n + 1)
        return out

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many items the suffixes from i and from j on have in common at their starts, i < j."""
        a, b = self.visit[i], self.visit[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        first, last = a // _BLOCK, b // _BLOCK
        out = np.minimum(self.right[a], self.left[b])
        same = np.flatnonzero(first == last)
        if len(same):
            least, at, stop = self.depths[a[same]], a[same].copy(), b[same]
            for _ in range(_BLOCK - 1):
                at = np.minimum(at + 1, stop)
                least = np.minimum(least, self.depths[at])
            out[same] = least
        between = last - first - 1
        for level, mins in enumerate(self.table):
            at = np.flatnonzero((between >> level > 0) & (between >> level + 1 == 0))
            if len(at):
                lo, hi = first[at] + 1, last[at] - (1 << level)
                out[at] = np.minimum(out[at], np.minimum(mins[lo], mins[hi]))
        return out.astype(np.int64)
