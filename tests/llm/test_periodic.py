"""Periodic runs: suffix trees against naive search, runs and collapsed texts against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from tillspark.llm import periodic, queries
from tillspark.llm.suffixtree import suffix_tree
from tillspark.llm.text import EXACT, words

from .conftest import messy_rows, with_clashes  # isort: skip
from .test_text_operators import spaced  # isort: skip


def smallest_period(s):
    fail, k = [0] * len(s), 0
    for i in range(1, len(s)):
        while k and s[i] != s[k]:
            k = fail[k - 1]
        k += s[i] == s[k]
        fail[i] = k
    return len(s) - fail[-1]


def brute_runs(w, least=24, times=3):
    found, a = [], np.unique(np.array(w, dtype=object).astype(str), return_inverse=True)[1] if w else np.zeros(0)
    for q in range(1, len(w) // times + 1):
        equal = np.r_[False, a[q:] == a[:-q], False]
        edges = np.flatnonzero(np.diff(equal.astype(int)))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if e - s + q >= max(least, times * q) and smallest_period(w[s : e + q]) == q:
                found.append((s, e - s + q, q))
    return sorted(found)


def brute_planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not w:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def brute_digest(doc_id, text, plant=True):
    w = brute_planted(doc_id, spaced(text)) if plant else spaced(text)
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    said = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha(said), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("seed", range(6))
def test_extensions_of_suffixes(seed):
    r = np.random.default_rng(seed)
    s = r.integers(1, 2 + seed, 60)
    tree = suffix_tree(s)
    n = len(s)
    a, b = np.triu_indices(n + 1, 1)

    def naive(i, j):
        k = 0
        while j + k < n and s[i + k] == s[j + k]:
            k += 1
        return k

    assert tree.lce(a, b).tolist() == [naive(i, j) for i, j in zip(a, b)]
    order = sorted(range(n + 1), key=lambda i: s[i:].tolist())
    assert np.argsort(tree.leaf).tolist() == order
    assert np.argsort(tree.leaf_reversed).tolist() == sorted(range(n + 1), key=lambda i: (-s[i:]).tolist())


@pytest.mark.parametrize("least,times", [(1, 2), (6, 3), (24, 3), (10, 5)])
def test_runs_of_numbers(least, times):
    r = random.Random(least)
    for _ in range(300):
        n, letters, p = r.randrange(1, 90), r.randrange(1, 4), r.randrange(1, 9)
        w = [r.randrange(letters) for _ in range(n)]
        if r.random() < 0.6:
            w = (w[:p] * 90)[:n]
            for _ in range(r.randrange(3)):
                w[r.randrange(n)] = r.randrange(letters)
        assert [tuple(x) for x in periodic.maximal_runs(np.array(w), least, times).tolist()] == brute_runs(w, least, times)


def test_no_run_outside_the_stretches():
    """Runs of exactly the least length, next to each other and in long surroundings, all lie inside one stretch."""
    import pyarrow as pa

    r = random.Random(3)
    for least, times in ((24, 3), (12, 3), (8, 2)):
        for _ in range(60):
            w = []
            for _ in range(r.randrange(1, 5)):
                w += [f"x{r.randrange(30)}" for _ in range(r.randrange(12))]
                q = r.randrange(1, 12)
                unit = [f"u{r.randrange(q + 1)}" for _ in range(q)]
                w += (unit * 40)[: max(least, times * q) - r.randrange(2)]
            split = words(pa.array([" ".join(w)]), EXACT)
            parts = [(a, b) for _, a, b in periodic.stretches(split, least, times)]
            for s, n, _ in brute_runs(w, least, times):
                assert any(a <= max(0, s - 1) and min(len(w), s + n + 1) <= b for a, b in parts)


def long_rows():
    r = random.Random(9)
    base = [f"w{r.randrange(5000)}" for _ in range(30_000)]
    looped = base[:700] + base[700:1900] * 4 + base[700:800] + base[2000:3000]
    return [(100, " ".join(base)), (101, "\n".join(looped)), (102, "tick " * 5_000), (103, "a b " * 11 + "a"), (104, "a b " * 12), (105, "x " * 23)]


def test_messy_rows(spark):
    rows = [r[:2] for r in messy_rows()] + long_rows()
    df = with_clashes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    found = periodic.digest(periodic.periodic_runs(df))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((brute_digest(*r, plant=False) for r in rows), key=repr)


def test_collapsed_text_and_words(spark):
    df = spark.createDataFrame([(1, "go  on\t" + "la le " * 20 + "end"), (2, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in periodic.periodic_runs(df).collect()}
    assert got[1].collapsed == "go on la le end" and got[1].n_words == 43
    assert [tuple(x) for x in got[1].runs] == [(2, 40, 2)]
    assert (got[2].n_words, got[2].runs, got[2].collapsed) == (0, [], "")


def test_planted_texts(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 7 * 9))) for i in range(400)] + [(None, "a b"), (5, None)]
    got = periodic.planted(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    expected = [(i, brute_planted(i, spaced(t))) for i, t in rows]
    assert sorted(((r.doc_id, spaced(r.text)) for r in got), key=repr) == sorted(expected, key=repr)


def test_query_on_the_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op11_periodic_runs"](spark, SF_DIR)
    assert dict(got.dtypes)["runs_sha256"] == "string" and all(t == "bigint" for c, t in got.dtypes if not c.endswith("sha256"))
    assert sorted(map(tuple, got.collect())) == sorted(brute_digest(*r) for r in docs)


def test_empty_table(spark, empty):
    assert periodic.digest(periodic.periodic_runs(periodic.planted(empty))).count() == 0
    assert periodic.periodic_runs(empty).where(F.size("runs") > 0).count() == 0
