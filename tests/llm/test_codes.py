"""Vector codes: active-entry rounds against plain Lloyd rounds in Python's whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillspark.llm import codes

from .conftest import with_clashes  # isort: skip

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def brute(rows, parts=8, entries=16, rounds=6, scale=4096, dims=16):
    kept = [r for r in rows if r[1] is not None and len(r[1]) == dims and all(x is not None and math.isfinite(x) and abs(x) < 8192 for x in r[1])]
    whole = [[math.floor(scale * x) for x in v] for _, v, _ in kept]
    width = dims // parts
    cut = [[w[p * width : (p + 1) * width] for p in range(parts)] for w in whole]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, whole[i]))[:entries]
    books = [[cut[i][p] for i in order] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    def assigned():
        return [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        found = assigned()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, f in zip(cut, found) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    found = assigned()
    errors = [sum(d for d, _ in f) for f in found]
    sums = {}
    for r, e in zip(kept, errors):
        sums[r[2]] = sums.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{k:02x}" for _, k in f), e, sums[r[2]], sha) for r, f, e in zip(kept, found, errors)), key=repr)


def coded(df, **options):
    return sorted(map(tuple, codes.digest(*codes.compress(df, group="label", **options)).collect()), key=repr)


def vectors(seed, n, dims=16, grid=None):
    r = random.Random(seed)
    point = (lambda: r.randrange(grid) / 4) if grid else (lambda: r.gauss(0, 0.4))
    return [(i * 3 + 1, [point() for _ in range(dims)], r.choice([0, 1, 2, None])) for i in range(n)]


def messy():
    rows = vectors(1, 150)
    rows += [(2, None, 1), (5, [0.1] * 15 + [None], 1), (8, [0.1] * 15 + [float("nan")], 0), (11, [float("inf")] + [0.0] * 15, None), (14, [], 1),
             (17, [0.5] * 8, 2), (20, [0.1] * 15, 2), (None, [0.25] * 16, None), (None, [-0.25] * 16, 2), (23, [1e9] * 16, 0), (26, [8000.0, -8000.0] * 8, 0)]
    return rows + rows[:3] + [(rows[0][0], rows[5][1], 1)]


def test_messy_vectors(spark):
    df = with_clashes(spark.createDataFrame(messy(), SCHEMA).repartition(5)).withColumn("code", F.lit("x")).withColumn("grp", F.lit("x"))
    assert coded(df) == brute(messy())


@pytest.mark.parametrize("grid", [2, 3, 5])
def test_ties_between_entries(spark, grid):
    """Components on a coarse grid: many equal distances, equal first vectors and entries without parts."""
    rows = vectors(grid, 120, 8, grid)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for entries, rounds in ((16, 6), (3, 1), (16, 0), (40, 9)):
        assert coded(df, entries=entries, rounds=rounds) == brute(rows, entries=entries, rounds=rounds, dims=8)


def test_fewer_vectors_than_entries_and_long_vectors(spark):
    for rows, dims in ((vectors(4, 5), 16), (vectors(5, 40, 1024), 1024), (vectors(6, 1), 16)):
        assert coded(spark.createDataFrame(rows, SCHEMA)) == brute(rows, dims=dims)


def test_a_part_whose_entry_stayed_looks_at_moved_entries_only(monkeypatch):
    r = np.random.default_rng(1)
    x, entries, looked = r.integers(-9, 9, (400, 2)), r.integers(-9, 9, (8, 2)), []
    plain = codes._distances
    code, distance = plain(x, entries).argmin(axis=1), plain(x, entries).min(axis=1)
    monkeypatch.setattr(codes, "_distances", lambda a, b: looked.append((len(a), len(b))) or plain(a, b))
    moved = np.zeros(8, bool)
    moved[[2, 5]] = True
    entries[moved] += r.integers(-4, 4, (2, 2))
    got = codes.reassign(x, entries, moved, code, distance)
    every = plain(x, entries)
    assert np.array_equal(got[0], every.argmin(axis=1)) and np.array_equal(got[1], every.min(axis=1))
    again = int(moved[code].sum())
    assert looked == [(again, 8), (400 - again, 2)]


def test_large_components_are_exact():
    r = np.random.default_rng(2)
    x, e = r.integers(-codes.LARGEST, codes.LARGEST, (50, 64)), r.integers(-codes.LARGEST, codes.LARGEST, (4, 64))
    assert codes._distances(x, e).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)) for w in e] for v in x]


def test_codes_give_vectors_back(spark):
    rows = vectors(7, 80)
    out, books = codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(3))
    errors = {r.vec_id: r.error for r in out.collect()}
    back = {r.vec_id: np.array(r.embedding) * 4096 for r in codes.restored(out, books).collect()}
    for vec_id, v, _ in rows:
        assert errors[vec_id] == ((np.floor(4096 * np.array(v)) - back[vec_id]) ** 2).sum()


def test_no_vectors(spark):
    for rows in ([], [(1, None, 1)], [(1, [float("nan")] * 8, None)], [(1, [], 1)]):
        assert coded(with_clashes(spark.createDataFrame(rows, SCHEMA))) == []
