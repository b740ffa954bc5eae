"""Suffix trees of word numbers by Ukkonen's rule, and longest common extensions by lowest common ancestors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _ukkonen(s: list[int], letters: int) -> tuple[dict[int, int], list[int], list[int], list[int]]:
    """The tree of ``s``: child by (node * letters + first letter), then start, stop (0: open) and suffix (-1: inner) of each node.

    One letter is added at a time; suffix links lead from a split to the next shorter one, so the whole takes linear time.
    """
    n = len(s)
    child: dict[int, int] = {}
    start, stop, link, suffix = [0], [0], [0], [-1]
    node = edge = length = waiting = 0
    for i, c in enumerate(s):
        waiting += 1
        last = 0
        while waiting:
            if not length:
                edge = i
            key = node * letters + s[edge]
            down = child.get(key)
            if down is None:
                child[key] = len(start)
                start.append(i)
                stop.append(0)
                link.append(0)
                suffix.append(i - waiting + 1)
                if last:
                    link[last] = node
                    last = 0
            else:
                at = start[down]
                size = (stop[down] or i + 1) - at
                if length >= size:
                    edge += size
                    length -= size
                    node = down
                    continue
                if s[at + length] == c:
                    length += 1
                    if last:
                        link[last] = node
                    break
                split = len(start)
                child[key] = split
                start += (at, i)
                stop += (at + length, 0)
                link += (0, 0)
                suffix += (-1, i - waiting + 1)
                start[down] = at + length
                child[split * letters + c] = split + 1
                child[split * letters + s[at + length]] = down
                if last:
                    link[last] = split
                last = split
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - waiting + 1
    return child, start, [x or n for x in stop], suffix


def _down(value: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Sum of ``value`` over each node and all above it (0 at the root), by doubling the steps upwards."""
    value, parent = value.copy(), parent
    while parent.any():
        value += value[parent]
        parent = parent[parent]
    return value


@dataclass
class SuffixTree:
    """``tour`` has the text depth of every node the Euler tour meets; ``leaf[i]`` is the place of suffix i on it."""

    tour: np.ndarray
    leaf: np.ndarray
    leaf_reversed: np.ndarray  # places if letters sorted the other way (the end of the text still first)

    def lce(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common beginning of the suffixes ``a`` and ``b``, all different, by range minima of the tour.

        The table of minima over 2**k places is kept for one k at a time, so memory stays a multiple of the tour.
        """
        lo, hi = np.minimum(self.leaf[a], self.leaf[b]), np.maximum(self.leaf[a], self.leaf[b])
        level = np.frexp((hi - lo + 1).astype(float))[1] - 1  # floor of the binary logarithm
        order = np.argsort(level, kind="stable")
        cuts = np.searchsorted(level[order], np.arange(level.max(initial=0) + 2))
        out, least = np.zeros(len(lo), np.int64), self.tour
        for k in range(len(cuts) - 1):
            q = order[cuts[k] : cuts[k + 1]]
            out[q] = np.minimum(least[lo[q]], least[hi[q] - (1 << k) + 1])
            if k + 2 < len(cuts):
                least = np.minimum(least[: len(least) - (1 << k)], least[1 << k :])
        return out


def suffix_tree(codes: np.ndarray) -> SuffixTree:
    """Tree of the numbers ``codes`` (1 and up); their end counts as a further letter, smaller than all others."""
    letters = int(codes.max(initial=0)) + 1
    child, start, stop, suffix = _ukkonen([*codes.tolist(), 0], letters)
    n = len(start)
    key = np.fromiter(child.keys(), np.int64, len(child))
    node = np.fromiter(child.values(), np.int64, len(child))
    parent, first = np.zeros(n, np.int64), np.zeros(n, np.int64)
    parent[node], first[node] = key // letters, key % letters
    edge = np.array(stop, np.int64) - np.array(start, np.int64)
    edge[0] = 0
    depth = _down(edge, parent)
    size = [1] * n
    above = parent.tolist()
    for v in np.argsort(-depth, kind="stable").tolist():
        if v:
            size[above[v]] += size[v]
    size = np.array(size, np.int64)

    def entered(letter: np.ndarray) -> np.ndarray:
        """Place of each node's first visit if siblings are visited by ``letter``; a node takes 2 * size - 1 places."""
        order = np.lexsort((letter[1:], parent[1:])) + 1
        before = np.cumsum(2 * size[order]) - 2 * size[order]
        group = np.flatnonzero(np.diff(parent[order], prepend=-1))
        before -= np.repeat(before[group], np.diff(np.append(group, len(order))))
        step = np.zeros(n, np.int64)
        step[order] = before + 1
        return _down(step, parent)

    place = entered(first)
    tour = np.empty(2 * n - 1, np.int64)
    tour[place] = depth
    tour[place[1:] + 2 * size[1:] - 1] = depth[parent[1:]]  # back at the parent after each child
    ends = np.array(suffix, np.int64)
    leaves = np.flatnonzero(ends >= 0)
    leaf, leaf_reversed = np.empty(len(leaves), np.int64), np.empty(len(leaves), np.int64)
    leaf[ends[leaves]] = place[leaves]
    leaf_reversed[ends[leaves]] = entered(np.where(first, letters - first, 0))[leaves]
    return SuffixTree(tour, leaf, leaf_reversed)
