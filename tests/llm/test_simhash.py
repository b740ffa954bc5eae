"""SimHash near duplicates: hashes against the reference package, trees and components against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import SF_DIR

from tillspark.llm import bktree, queries, simhash
from tillspark.llm.text import SPACED, words
from tillspark.llm.xxh64 import xxh64

from .conftest import messy_rows, text, with_clashes  # isort: skip
from .test_text_operators import lower, spaced  # isort: skip


def brute_print(t):
    w = spaced(lower(t))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=3):
    """Component of each fingerprint by comparing all pairs."""
    values = np.array(sorted(prints), np.uint64)
    label = np.arange(len(values))
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= radius) + i + 1:
            a, b = label[i], label[j]
            label[label == max(a, b)] = min(a, b)
    return dict(zip(values.tolist(), label.tolist()))


def brute(rows, radius=3):
    prints = [brute_print(t) for _, t, *_ in rows]
    group = brute_components(set(prints), radius)
    least = {}
    for r, p in zip(rows, prints):
        if r[0] is not None:
            least[group[p]] = min(r[0], least.get(group[p], r[0]))
    return sorted(((r[0], f"{p:016x}", least.get(group[p])) for r, p in zip(rows, prints)), key=repr)


def found(df, **options):
    out = simhash.near_duplicates(df, **options)
    return sorted(map(tuple, out.select("doc_id", simhash.hexadecimal("fp"), "component_id").collect()), key=repr)


def test_xxh64():
    r = random.Random(1)
    data = np.frombuffer(r.randbytes(4000), np.uint8)
    start = np.array([r.randrange(3000) for _ in range(2000)])
    size = np.array([r.choice([0, 1, 3, 4, 7, 8, 20, 31, 32, 33, 64, r.randrange(300)]) for _ in range(2000)])
    expected = [xxhash.xxh64_intdigest(data[a : a + n].tobytes(), 42) for a, n in zip(start, size)]
    assert xxh64(data, start, size, 42).tolist() == expected


def test_fingerprints_of_texts():
    texts = ["", None, "a", "A b", "x\ty  z", "x y z " * 700, "Été ÀB cd ef " * 5, text(3, 20_000)] + [text(i, i) for i in range(60)]
    assert simhash.simhash(words(pa.array(texts), SPACED)).tolist() == [brute_print(t) for t in texts]


@pytest.mark.parametrize("radius", [0, 1, 3, 9])
def test_trees_find_all_pairs(radius):
    r = np.random.default_rng(radius)
    base = r.integers(0, 1 << 63, 200, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (4, 200)).astype(np.uint64))
    values = r.permutation(np.unique(np.concatenate([base, base ^ flips, np.arange(40, dtype=np.uint64)])))
    first = np.array([0, 1, 90, 91, 300])
    forest = bktree.plant(values, first)
    assert np.all(np.diff(forest.edge) >= 0) and sorted(forest.origin.tolist()) == list(range(len(values)))
    root = np.searchsorted(first, np.arange(len(values)), "right") - 1
    got = set()
    for q, n in bktree.near(forest, values, root, radius):
        got |= set(zip(q.tolist(), forest.origin[n].tolist()))
    close = (np.bitwise_count(values[:, None] ^ values[None, :]) <= radius) & (root[:, None] == root[None, :])
    assert got == set(zip(*(x.tolist() for x in np.nonzero(close))))
    back = bktree.Forest.unpack(forest.pack())
    assert np.array_equal(back.value, forest.value) and np.array_equal(back.edge, forest.edge)


def test_search_skips_branches_and_splits_its_front(monkeypatch):
    values = np.random.default_rng(2).integers(0, 1 << 63, 4000, dtype=np.uint64)
    values = np.unique(values)
    forest, looked = bktree.plant(values, np.zeros(1, np.int64)), []
    plain = np.bitwise_count

    monkeypatch.setattr(bktree.np, "bitwise_count", lambda x: looked.append(len(x)) or plain(x))
    monkeypatch.setattr(bktree, "FRONT", 500)
    hits = [n for _, n in bktree.near(forest, values, np.zeros(len(values), np.int64), 3)]
    assert sum(map(len, hits)) == len(values) and sum(looked) < 0.5 * len(values) ** 2


def test_messy_rows(spark):
    near = [(200 + i, text(50, 400) + f" tail{i}") for i in range(20)]
    rows = [r[:2] for r in messy_rows()] + near + [(None, "only here"), (None, "only here")]
    df = with_clashes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    assert found(df) == brute(rows)


@pytest.mark.parametrize("shard", [1024, 40, 7])
def test_links_of_fingerprints_in_one_hot_bucket(spark, shard):
    """A third of all fingerprints share three of the four blocks, so one bucket is cut into many shards that must meet."""
    r = np.random.default_rng(5)
    hot = np.uint64(0xABCDEF0123450000) | np.unique(r.integers(0, 1 << 16, 160)).astype(np.uint64)
    spread = r.integers(0, 1 << 63, 200, dtype=np.uint64)
    values = np.unique(np.concatenate([hot, spread, spread[:60] ^ np.uint64(0x8000100000000001), spread[:30] ^ np.uint64(1 << 20)]))
    df = spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fp bigint").repartition(3)
    found = simhash.links(df, shard=shard).collect()
    pairs = np.array([(x.a, x.b) for x in found], np.int64).view(np.uint64)
    assert np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]).max() > 0
    label = {int(v): i for i, v in enumerate(values)}
    joined = np.arange(len(values))
    a, b = ([label[int(x)] for x in pairs[:, k]] for k in (0, 1))
    joined = bktree.joined(joined, np.array(a), np.array(b))
    expected = brute_components(values.tolist())
    groups = lambda of: sorted(sorted(k for k in of if of[k] == g) for g in set(of.values()))
    assert groups({int(v): int(joined[i]) for i, v in enumerate(values)}) == groups(expected)


def test_other_radius(spark):
    rows = [(i, text(60 + i // 3, 300) + " x" * (i % 3)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for radius in (0, 1, 8):
        assert found(df, radius=radius, shard=5) == brute(rows, radius)


def test_query_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op13_simhash_near_dedup"](spark, SF_DIR)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_empty_table(spark, empty):
    assert simhash.near_duplicates(empty).count() == 0
