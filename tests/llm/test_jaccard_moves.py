"""What the Jaccard join moves: sketches bound differences, and sets of pairs that can't link stay where they are."""

import numpy as np
import pytest

from tillspark.llm import jaccard


@pytest.mark.parametrize("one, two", [(1, 1), (40, 45), (300, 3000), (5000, 20)])
def test_sketches_never_overstate(one, two):
    draw = np.random.default_rng(one)
    pool = draw.integers(0, 1 << 63, one + two, dtype=np.uint64)
    a, b = np.unique(pool[:one]), np.unique(np.append(pool[one // 2 : one], pool[one : one + two - one // 2]))
    found = jaccard._differing(jaccard._sketch(a), jaccard._sketch(b))
    assert found == jaccard._differing(jaccard._sketch(b), jaccard._sketch(a)) <= len(np.setxor1d(a, b))
    assert jaccard._differing(jaccard._sketch(a), jaccard._sketch(a)) == 0


def test_far_pairs_are_not_compared(spark, monkeypatch):
    """Thirty documents share two fifths of their words, too little to link; two others link to two of them."""
    draw = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in draw.integers(0, 10**9, n)]
    common = word(80)
    texts = [common + word(120) for _ in range(30)]
    texts += [texts[3][:190] + word(6), word(4) + texts[7]]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    met, overlaps = [], jaccard._overlaps

    def seen(*given):
        out = overlaps(*given)
        met.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "_overlaps", seen)
    found = {r.doc_id: r.component_id for r in jaccard.linked(docs).collect()}
    assert found == {k: {30: 3, 31: 7}.get(k, k) for k in range(32)}
    assert met[0] < 30  # of 435 pairs that share rare shingles


def test_packets_keep_every_entry():
    import pyarrow as pa

    draw = np.random.default_rng(1)
    sizes = [1, 3, 700, 40]
    items = [np.sort(draw.integers(0, 1 << 48, k, dtype=np.uint64)) for k in sizes]
    rows = pa.RecordBatch.from_arrays(
        [pa.array([jaccard._pack(x << np.uint64(16)) for x in items], pa.binary()), pa.array([1, 3, 70_000, 40], pa.int32()), pa.array([9, -8, 7, 1 << 40], pa.int64())],
        names=["prefix", "n", "cluster"],
    )
    entries = set()
    for part, tokens, counts, position, cluster, n in (tuple(r.values()) for b in jaccard._packets(iter([rows]), 2) for r in b.to_pylist()):
        cluster = np.frombuffer(cluster, np.int64)
        held = jaccard._long(counts, len(cluster))
        columns = np.frombuffer(tokens, np.uint32), np.frombuffer(position, np.uint16), np.repeat(cluster, held), np.repeat(jaccard._long(n, len(cluster)), held)
        entries |= {(part, *x) for x in zip(*(c.tolist() for c in columns))}
    full = zip(items, [1, 3, 70_000, 40], [9, -8, 7, 1 << 40])
    assert entries == {(int(t) % 2, int(t) // 2 & 0xFFFFFFFF, k, c, n) for x, n, c in full for k, t in enumerate(x)}
