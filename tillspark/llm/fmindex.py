"""A compressed full-text index over numbers: Burrows-Wheeler transform in a wavelet matrix, for patterns of bounded length."""

from __future__ import annotations

import numpy as np

_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)  # the bits of a word before each of its bits


def _ranked(keys: np.ndarray) -> np.ndarray:
    """Ranks of numbers, from 1."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), np.int64)
    new[1:] = ordered[1:] != ordered[:-1]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(new)
    return out


def _window_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the first ``depth`` symbols of each suffix (zeros follow the text). As many known ranks as fit 63 bits are read
    as one number a step; the last ones may overlap those before, which agree with them."""
    ranks, have = text.astype(np.int64), 1
    while True:
        width = int(ranks.max(initial=0)).bit_length() or 1
        count = min(max(63 // width, 2), -(-depth // have))  # two always fit: ranks are below 2**31
        reach = min(count * have, depth)
        keys = ranks.copy()
        for k in range(1, count):
            by = min(k * have, reach - have)
            keys <<= width
            keys[: max(0, len(keys) - by)] |= ranks[by:]
        ranks, have = _ranked(keys), reach
        if have == depth:
            return ranks


class FMIndex:
    """Index of ``text`` (numbers from 0; 0 ends each of its parts, so the last is 0) for patterns of up to ``depth`` symbols.

    Suffixes are ordered by their first ``depth`` symbols and then by position, which is all that backward search of such
    patterns needs; the first row of a full pattern's interval is therefore its first occurrence.
    """

    def __init__(self, text: np.ndarray, depth: int):
        self.depth = depth
        self.ranks = _window_ranks(text, depth)  # equal where the next ``depth`` symbols are
        width = len(text).bit_length()
        self.suffixes = np.argsort(self.ranks << width | np.arange(len(text)))
        last = text[self.suffixes - 1]
        counts = np.bincount(text)
        self.first = np.append(0, np.cumsum(counts))
        self.bits, self.ones, self.zeros = [], [], []
        for level in range(max(1, int(len(counts) - 1).bit_length()) - 1, -1, -1):
            bit = (last >> level) & 1 > 0
            packed = np.packbits(np.append(bit, np.zeros(-len(bit) % 64 + 64, bool)), bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.ones.append(np.append(0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)))
            self.zeros.append(len(bit) - int(bit.sum()))
            last = np.concatenate([last[~bit], last[bit]])
        self.base = self._descend(np.arange(len(counts)), np.zeros(len(counts), np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        top = len(self.bits) - 1
        for k, (packed, ones, zeros) in enumerate(zip(self.bits, self.ones, self.zeros)):
            word = at >> 6
            before = ones[word] + np.bitwise_count(packed[word] & _BELOW[at & 63])
            at = np.where(symbols & (1 << top - k), zeros + before, at - before)
        return at

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns that have one more symbol in front."""
        found = self._descend(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        shift = self.first[symbols] - self.base[symbols]
        return found[: len(low)] + shift, found[len(low) :] + shift

    def search(self, text: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which positions of ``text`` (of this alphabet) begin ``size`` symbols that the index holds more than once, and their
        intervals. The search runs backwards and leaves a position when a match ends: when one occurrence is left or none."""
        left = np.arange(len(at))
        symbols = text[at + size - 1]
        low, high = self.first[symbols], self.first[symbols + 1]
        for k in range(size - 2, -1, -1):
            more = high - low > 1
            if not more.all():
                left, low, high = left[more], low[more], high[more]
            low, high = self.extend(text[at[left] + k], low, high)
        more = high - low > 1
        return left[more], low[more], high[more]
