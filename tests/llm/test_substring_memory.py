"""Substring dedup: what a task holds does not follow the size of the batches it is given."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tillspark.llm import substrings


def texts(megabytes):
    draw = np.random.default_rng(5)
    names = np.array([f"w{k:04d}" for k in range(5000)])
    return [" ".join(names[draw.integers(0, 5000, 3500)]) for _ in range(48 * megabytes)]


def peak_of(work) -> float:
    tracemalloc.start()
    try:
        for _ in work:
            pass
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("megabytes", [2, 12])
def test_anchors_of_a_large_batch(megabytes):
    batch = pa.RecordBatch.from_arrays([pa.array(texts(megabytes))], names=["text"])
    assert peak_of(substrings._anchors(iter([batch]), 50, 20, 8)) < 110


def test_small_chunks_have_the_same_anchors(monkeypatch):
    batches = [pa.RecordBatch.from_arrays([pa.array([*texts(1), None, "", "a b c"])], names=["text"])] * 2
    found = []
    for chunk, packed in ((1 << 30, 1), (substrings.CHUNK, 1 << 30), (20_000, 500)):
        monkeypatch.setattr(substrings, "CHUNK", chunk)
        monkeypatch.setattr(substrings, "PACKED", packed)
        rows = [(p, a) for b in substrings._anchors(iter(batches), 7, 20, 8) for p, a in zip(*(c.to_pylist() for c in b.columns))]
        found.append({p: sorted(np.concatenate([np.frombuffer(a, np.uint64) for q, a in rows if q == p]).tolist()) for p in range(7)})
    assert found[0] == found[1] == found[2] and all(found[0].values())


def test_documents_are_cut_in_parts_of_a_batch():
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(576)), pa.array(texts(12)), *(pa.nulls(576, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary())))],
        names=["doc_id", "text", "text_hash", "hit_doc", "hit_text", "places"],
    )
    out = list(substrings._cut(iter([batch]), 20, ("n_words", "n_removed", "kept")))
    assert len(out) > 10 and pa.Table.from_batches(out)["kept"].to_pylist() == batch.column("text").to_pylist()
    assert set(pa.Table.from_batches(out)["n_words"].to_pylist()) == {3500}
