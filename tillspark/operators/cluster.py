"""Customer clusters: scaling, elbow, K-Means, two-dimensional projection, profile and labels."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from math import inf

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillspark.functions import exprs as X
from tillspark.session import materialise

FEATURES = (
    "total_spend", "average_transaction_value", "transaction_count", "total_items",
    "average_items_per_transaction", "average_price", "average_spend_per_item",
)


MAX_ITERATIONS = 300  # of a K-Means fit; it stops earlier when the centres stand still
STARTING_ROWS = 4096  # rows that starting centres are drawn from
_ROWS = 2048  # rows that a task measures at once: their distances to all centres of all fits fit the cache


def scaled(customers: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Centred and scaled feature vectors. The customer table is checkpointed before the scaler reads it, so the sales behind
    it are aggregated once, and the vectors are checkpointed because every fit below reads them."""
    table = materialise(customers)
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True),
    ]
    # spread after scaling: other parts would change the last digits of the means, and so the hashes that choose starting rows
    return materialise(spread(Pipeline(stages=stages).fit(table).transform(table).drop("_raw")))


def spread(points: DataFrame) -> DataFrame:
    """The rows in as many parts as there are cores: an aggregation leaves its small result in a few, and each part is one task of
    every K-Means iteration."""
    return points.repartition(points.sparkSession.sparkContext.defaultParallelism)


def starting_centres(points: DataFrame, jobs: Sequence[tuple[int, int]], size: int = STARTING_ROWS) -> list[np.ndarray]:
    """Centres for each (k, seed), drawn by k-means++ from at most ``size`` rows: those with the smallest hashes."""
    x = vector_to_array("features")
    rows = points.select(x.alias("x")).orderBy(F.xxhash64("x"), "x").limit(size).toArrow().column("x").to_pylist()
    sample = np.array(rows, float)

    def drawn(k: int, seed: int) -> np.ndarray:
        random = np.random.default_rng([seed, k])
        chosen = [int(random.integers(len(sample)))]
        far = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
        while len(chosen) < min(k, len(sample)):
            weight = far / far.sum() if far.sum() > 0 else np.full(len(far), 1 / len(far))
            chosen.append(int(random.choice(len(sample), p=weight)))
            far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        return sample[chosen]

    return [drawn(*job) for job in jobs]


def lloyd(points: DataFrame, starts: Sequence[np.ndarray], iterations: int = MAX_ITERATIONS, tolerance: float = 1e-4) -> tuple[list[np.ndarray], np.ndarray]:
    """Centres and inertia of many K-Means fits that move together: one scan and one aggregation an iteration for all of them.

    Every task adds up, for each centre of each fit, its rows; what comes back is one row a centre, whatever the number of rows. A
    centre without rows stays. A fit is done when no centre moves by more than ``tolerance``; the inertia belongs to the
    centres it then has, and one last scan adds it up. ``points`` should have been written, as each iteration reads them.
    """
    centres = [np.array(c, float) for c in starts]
    if not centres:
        return [], np.empty(0)
    active = list(range(len(centres)))
    blocks = _blocks(points).persist(StorageLevel.MEMORY_AND_DISK)
    for _ in range(iterations):
        if not active:
            break
        held, edges = np.concatenate([centres[f] for f in active]), np.cumsum([0, *(len(centres[f]) for f in active)]).tolist()
        total = _gathered(blocks, _near_sums, held, edges, held.shape[1] + 1)
        for f, x, y in list(zip(active, edges, edges[1:])):
            rows = total[x:y, -1:]
            moved = np.where(rows > 0, total[x:y, :-1] / np.maximum(rows, 1), centres[f])
            if np.sqrt(((moved - centres[f]) ** 2).sum(axis=1)).max() <= tolerance:
                active.remove(f)
            else:
                centres[f] = moved
    edges = np.cumsum([0, *(len(c) for c in centres)]).tolist()
    cost = _gathered(blocks, _near_costs, np.concatenate(centres), edges, 1)[:, 0]
    blocks.unpersist()
    return centres, np.add.reduceat(cost, edges[:-1])


def _blocks(points: DataFrame) -> RDD:
    """The vectors as matrices (columns x rows), which every iteration reads without a new query."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("x").flatten()).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(np.ascontiguousarray(x.T))], pa.binary())], names=["block"])

    vectors = points.select(vector_to_array("features").alias("x"))
    return vectors.mapInArrow(pack, "block binary").rdd.map(lambda row: pickle.loads(row.block))


def _gathered(blocks: RDD, sums: Callable, centres: np.ndarray, edges: list[int], width: int) -> np.ndarray:
    """Sums over all rows, one line a centre. ``centres`` holds those of all fits; ``edges`` says where a fit's begin."""

    def add(total: np.ndarray | float, x: np.ndarray) -> np.ndarray:
        own = np.zeros((len(centres), width))
        for i in range(0, x.shape[1], _ROWS):
            sums(own, np.ascontiguousarray(x[:, i : i + _ROWS]), centres, edges)
        return total + own

    depth = 1 if blocks.getNumPartitions() <= 256 else 2
    return np.zeros((len(centres), width)) + blocks.treeAggregate(0.0, add, np.add, depth)


def _nearest(x: np.ndarray, centres: np.ndarray, edges: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """For each fit its edges and the nearest centre of every row (``x``: columns x rows). The square of the row itself is left
    out of the distance, as it is the same for all centres."""
    far = (centres**2).sum(axis=1)[:, None] - 2 * (centres @ x)
    for a, b in zip(edges, edges[1:]):
        yield a, b, far[a:b].argmin(axis=0)


def _near_sums(total: np.ndarray, x: np.ndarray, centres: np.ndarray, edges: list[int]) -> None:
    """Adds each row, and 1, to its nearest centre of every fit."""
    for a, b, near in _nearest(x, centres, edges):
        own = (near == np.arange(b - a)[:, None]).astype(float)
        total[a:b, :-1] += own @ x.T
        total[a:b, -1] += own.sum(axis=1)


def _near_costs(total: np.ndarray, x: np.ndarray, centres: np.ndarray, edges: list[int]) -> None:
    """Adds each row's squared distance to its nearest centre of every fit."""
    for a, b, near in _nearest(x, centres, edges):
        total[a:b, 0] += np.bincount(near, ((x - centres[a:b][near].T) ** 2).sum(axis=0), b - a)


def elbow(points: DataFrame, max_k: int = 10, starts: int = 10, seed: int = 42) -> DataFrame:
    """Inertia for k = 1..max_k, best of ``starts`` initialisations; no table without rows."""
    rows = points.count()
    jobs = [(k, seed + i) for k in range(1, min(max_k, rows) + 1) for i in range(starts if k > 1 else 1)]
    costs = lloyd(points, starting_centres(points, jobs))[1] if jobs else []
    best: dict[int, float] = {}
    for (k, _), value in zip(jobs, costs):
        best[k] = min(best.get(k, inf), float(value))
    return points.sparkSession.createDataFrame(sorted(best.items()), "k int, inertia double")


def pick_k(inertia: Sequence[float], default: int = 3, bend: float = 2.0) -> int:
    """First k where the drop before it is more than ``bend`` times the drop after it."""
    for i in range(1, len(inertia) - 1):
        after = inertia[i] - inertia[i + 1]
        if after != 0 and (inertia[i - 1] - inertia[i]) / after > bend:
            return i + 1
    return default


def assign(points: DataFrame, k: int, starts: int = 10, seed: int = 42) -> DataFrame:
    """Cluster of every customer, from the best of the fits that ``elbow`` makes for this ``k``."""
    centres, cost = lloyd(points, starting_centres(points, [(k, seed + i) for i in range(starts)]))
    best = centres[int(np.argmin(cost))]
    # equal clusters get equal numbers in every run: by their centres
    best = best[np.lexsort(best.T[::-1])]

    @F.pandas_udf("int")
    def nearest(x: pd.Series) -> pd.Series:
        rows = np.stack(x.to_numpy()) if len(x) else np.zeros((0, best.shape[1]))
        return pd.Series(((rows[:, None, :] - best[None, :, :]) ** 2).sum(axis=2).argmin(axis=1))

    return points.withColumn("cluster", nearest(vector_to_array("features")))


def project(points: DataFrame) -> DataFrame:
    """First two principal components of the centred features. The sign of a component is arbitrary."""
    model = PCA(k=2, inputCol="features", outputCol="_pc").fit(points)
    pc = vector_to_array("_pc")
    return model.transform(points).withColumns({"pc1": pc[0], "pc2": pc[1]}).drop("_pc")


# Labels of a cluster, tested in this order; rich and frequent mean more than 1.5 times the overall mean of
# spend and of purchases, poor less than 0.5 times that of spend.
LABELS = (
    ("HIGH-VALUE LOYAL CUSTOMERS", ("rich", "frequent")),
    ("BIG SPENDERS (HIGH VALUE, LESS FREQUENT)", ("rich",)),
    ("FREQUENT SHOPPERS (REGULAR VISITORS)", ("frequent",)),
    ("LOW-VALUE CUSTOMERS", ("poor",)),
    ("AVERAGE CUSTOMERS", ()),
)


def profile(clustered: DataFrame) -> DataFrame:
    """Size, share, spend and purchase means of each cluster, with a label.

    Clusters are summed once; the overall means follow from the cluster sums, so customers are read a single time.
    """
    sums = clustered.groupBy("cluster").agg(
        X.rows().alias("size"),
        F.sum("total_spend").alias("_spend"),
        F.sum("transaction_count").alias("_count"),
        F.min("total_spend").alias("min_spend"),
        F.max("total_spend").alias("max_spend"),
        F.avg("average_transaction_value").alias("avg_transaction_value"),
        F.avg("total_items").alias("avg_items"),
        F.avg("average_items_per_transaction").alias("avg_items_per_transaction"),
    )
    sums = materialise(sums)
    overall = sums.agg(
        F.struct(F.sum("size").alias("n"), F.sum("_spend").alias("spend"), F.sum("_count").alias("count"))
    ).scalar()
    table = sums.withColumn("_all", overall).select(
        "cluster",
        "size",
        X.ratio(F.col("size") * 100, "_all.n").alias("share_pct"),
        X.ratio("_spend", "size").alias("avg_spend"),
        "min_spend",
        "max_spend",
        X.ratio("_count", "size").alias("avg_transactions"),
        "avg_transaction_value",
        "avg_items",
        "avg_items_per_transaction",
        X.ratio("_all.spend", "_all.n").alias("_mean_spend"),
        X.ratio("_all.count", "_all.n").alias("_mean_count"),
    )
    traits = {
        "rich": F.col("avg_spend") > F.col("_mean_spend") * 1.5,
        "frequent": F.col("avg_transactions") > F.col("_mean_count") * 1.5,
        "poor": F.col("avg_spend") < F.col("_mean_spend") * 0.5,
    }
    fits = [(name, [F.coalesce(traits[t], F.lit(False)) for t in wanted]) for name, wanted in LABELS]
    label = F.coalesce(*(F.when(reduce(Column.__and__, wanted, F.lit(True)), name) for name, wanted in fits))
    return table.withColumn("segment_label", label).drop("_mean_spend", "_mean_count").orderBy("cluster")
