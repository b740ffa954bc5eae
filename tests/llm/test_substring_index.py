"""The index of substring dedup: order of its suffixes, and equal windows searched once."""

import numpy as np
import pytest

from tillspark.llm import substrings
from tillspark.llm.fmindex import FMIndex


@pytest.mark.parametrize("symbols, depth", [(2, 20), (5, 7), (300, 20), (5000, 3)])
def test_suffixes_by_depth_then_place(symbols, depth):
    draw = np.random.default_rng(symbols)
    text = np.append(draw.integers(0, symbols, 400), 0)
    text[200:260] = text[20:80]
    text[np.unique(text, return_index=True)[1]] = np.arange(len(np.unique(text)))
    padded = np.append(text, np.zeros(depth, np.int64)).tolist()
    heads = [tuple(padded[i : i + depth]) for i in range(len(text))]
    index = FMIndex(text, depth)
    assert index.suffixes.tolist() == sorted(range(len(text)), key=lambda i: (heads[i], i))
    assert len(set(zip(index.ranks.tolist(), heads))) == len(set(heads)) == len(set(index.ranks.tolist()))


def test_equal_windows_are_searched_once(monkeypatch):
    """Forty documents with the same 30 words make 11 windows of 20, each searched once; all but the first document's repeat."""
    searched = []
    search = FMIndex.search
    monkeypatch.setattr(FMIndex, "search", lambda self, text, at, size: (searched.append(len(at)), search(self, text, at, size))[1])
    words = np.random.default_rng(3).integers(1, 1 << 60, 30, dtype=np.uint64)
    n = 40
    found = substrings._found(np.arange(n)[::-1], np.arange(n), np.zeros(n, np.int32), np.full(n, 11, np.int32), np.tile(words, n), 20)
    hits = {d: np.frombuffer(p, np.int32).reshape(-1, 2).tolist() for b in found for d, p in zip(*(b.column(c).to_pylist() for c in ("hit_doc", "places")))}
    assert hits == {d: [[k, 1] for k in range(11)] for d in range(1, n)}
    assert sum(searched) == 11


@pytest.mark.parametrize("span", [1, 2, 5, 13])
def test_smallest_of_each_span(span):
    x = np.random.default_rng(span).integers(0, 6, 200).astype(np.uint64)
    assert substrings._smallest(x, span).tolist() == [i + int(x[i : i + span].argmin()) for i in range(len(x) - span + 1)]
