"""Words and word n-grams of whole texts as numpy arrays, computed on Arrow batches inside tasks.

Texts are read as UTF-8 bytes. A rule (``SPACED`` or ``PLAIN``) says which bytes belong to words and whether A-Z are
lower-cased, so the byte view and the character view of a rule agree. Words are named by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK = 2 << 20  # bytes of text worked on at a time; a longer text is a chunk of its own
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = 0xD6E8FEB86659FD93


@dataclass(frozen=True)
class Rule:
    inside: np.ndarray  # 256 flags: the byte belongs to a word
    value: np.ndarray  # 256 random numbers, equal for bytes that count as equal


def _rule(outside, lower: bool) -> Rule:
    inside = np.ones(256, bool)
    inside[list(outside)] = False
    value = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64)
    if lower:
        value[65:91] = value[97:123]
    return Rule(inside, value)


_BLANK = [0x20, *range(0x09, 0x0E)]
_NOT_ALNUM = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
SPACED = _rule(_BLANK, lower=True)  # words [^\x20\x09-\x0D]+ after lower-casing A-Z
EXACT = _rule(_BLANK, lower=False)  # the same words, unchanged
PLAIN = _rule(_NOT_ALNUM, lower=True)  # words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z

_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of some texts, in order: ``hash``, byte range, and for text i the words first[i]..first[i+1]-1."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    head: np.ndarray | None = None  # hash of the first bytes of each word

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def left(self) -> np.ndarray:
        """For each word, how many words its text has from there on."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.hash))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def words(texts: pa.Array, rule: Rule, head: int = 0) -> Words:
    """Split texts (null counts as empty) into words; with ``head``, also hash the first so many bytes of each."""
    data, offsets = _bytes(texts)
    if not len(data):
        none = np.empty(0, np.int64)
        return Words(data, none, none, none.astype(np.uint64), np.zeros(len(offsets), np.int64), none.astype(np.uint64))
    inside = rule.inside[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edges[edges > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    up, down = _power(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(rule.value[data] * up[: len(data)], out=sums[1:])

    def named(stop: np.ndarray) -> np.ndarray:
        return mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))

    heads = named(np.minimum(end, start + head)) if head else None
    return Words(data, start, end, named(end), np.searchsorted(start, offsets), heads)


def windows(w: Words, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on; meaningful only where ``w.left() >= size``."""
    out = np.zeros(len(w.hash), np.uint64)
    for k in range(min(size, len(w.hash))):
        out[: len(w.hash) - k] += w.hash[k:] * np.uint64(pow(_STEP, k, 1 << 64))
    return mix(out)


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``size`` bytes together; a longer text comes alone."""
    _, offsets = _bytes(texts)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi
        lo = hi


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of ``df`` starts with, so that it serves as a name and as a prefix."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name += "_"
    return name


def with_arrow(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with further columns behind its own."""
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])
