import numpy as np
import pytest

from tillspark.llm import neighbours
from tillspark.llm.queries import QUERIES


def mixed(kind: str, n=4000, size=64):
    rng = np.random.default_rng(11)
    middle = rng.normal(size=(60, size))
    x = middle[rng.integers(0, 60, n)] + 0.6 * rng.normal(size=(n, size))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    if kind == "one":
        x[7] *= 3
    if kind == "all":
        x *= rng.lognormal(0, 0.5, (n, 1))
    return x.astype(np.float32)


def recall(spark, tmp_path, x) -> float:
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = QUERIES["op3_nearest_neighbours"](spark, str(tmp_path)).toPandas()
    x, shares = x.astype(float), []
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        shares.append(len(set(np.argsort(-s)[:20].tolist()) & set(found.vec_id[found.query_id == q])) / 20)
    return float(np.mean(shares))


@pytest.mark.parametrize("kind", ["none", "one", "all"])
def test_nearest_keeps_recall_at_the_registered_factor(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 1000)
    assert recall(spark, tmp_path, mixed(kind)) >= 0.9


def test_nearest_halves_a_factor_that_loses_neighbours(spark, tmp_path, monkeypatch):
    """Directions without clusters: chords to far neighbours are long, and a factor of 4 drops most of them."""
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 1000)
    x = np.random.default_rng(12).normal(size=(4000, 16)).astype(np.float32)
    assert recall(spark, tmp_path, x) >= 0.9
