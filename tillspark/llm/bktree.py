"""Forests of BK-trees over 64-bit numbers and Hamming distance, as numpy arrays: built level by level, searched by frontiers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

FRONT = 1 << 20  # (query, node) pairs looked at together; more wait on a stack
_EDGES = 65  # distances of 64-bit numbers: 0 to 64


@dataclass
class Forest:
    """Nodes level by level, roots first. ``edge`` is parent * 65 + distance to the parent, -1 for a root; it never falls, so the
    children of a node stand together in the order of their distances."""

    value: np.ndarray
    edge: np.ndarray
    origin: np.ndarray  # place of each node among the numbers given

    def pack(self) -> bytes:
        return self.value.tobytes() + self.edge.tobytes()

    @staticmethod
    def unpack(data: bytes) -> Forest:
        n = len(data) // 16
        return Forest(np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.int64, n, 8 * n), np.arange(n))


def plant(values: np.ndarray, first: np.ndarray) -> Forest:
    """One tree for each part of ``values`` that starts at ``first``; the numbers of a part differ from each other.

    All numbers go down their trees together. Of those that meet at a node with the same distance, the first becomes the child
    and the others go on below it, which is the tree that inserting one after the other makes.
    """
    rest = np.setdiff1d(np.arange(len(values)), first, assume_unique=True)
    node = np.searchsorted(first, rest, "right") - 1
    origin, edges, known = [first], [np.full(len(first), -1, np.int64)], len(first)
    places = first
    while len(rest):
        key = node * _EDGES + np.bitwise_count(values[rest] ^ values[places[node]]).astype(np.int64)
        order = np.argsort(key, kind="stable")
        key, rest = key[order], rest[order]
        new = np.diff(key, prepend=-1) != 0
        origin.append(rest[new])
        edges.append(key[new])
        node = (known + np.cumsum(new) - 1)[~new]
        rest = rest[~new]
        known += len(origin[-1])
        places = np.concatenate([places, origin[-1]])
    return Forest(values[places], np.concatenate(edges), places)


def near(forest: Forest, queries: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) pairs at most ``radius`` apart, in portions; query i starts at node roots[i].

    From a node at distance d only the children at d - radius to d + radius are followed: no other can hold a number that near.
    """
    waiting = [(np.arange(len(queries)), roots)]
    while waiting:
        query, node = waiting.pop()
        if len(query) > FRONT:
            waiting += [(query[FRONT:], node[FRONT:]), (query[:FRONT], node[:FRONT])]
            continue
        d = np.bitwise_count(queries[query] ^ forest.value[node]).astype(np.int64)
        hit = d <= radius
        yield query[hit], node[hit]
        lo = np.searchsorted(forest.edge, node * _EDGES + np.maximum(d - radius, 0))
        hi = np.searchsorted(forest.edge, node * _EDGES + np.minimum(d + radius, _EDGES - 1), "right")
        many = hi - lo
        ends = np.cumsum(many)
        a = 0
        while a < len(many):  # pieces of at most FRONT pairs, or the children of one pair
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + FRONT, "right")))
            n = many[a:b]
            if n.any():
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                waiting.append((np.repeat(query[a:b], n), np.repeat(lo[a:b], n) + step))
            a = b


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the smallest member of each group) after the groups of a[i] and b[i] have been put together."""
    while True:
        x, y = label[a], label[b]
        if np.array_equal(x, y):
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, label[label]):
            label = label[label]
