"""Nearest neighbours by inner product with a vantage-point tree per shard.

Trees and shards are over directions (vectors of norm 1), where the triangle inequality holds for chords, and keep the largest
and smallest norm of what is in them: a product above the query's 20th so far then needs a chord that is short enough for that
norm. A tree's vectors are split into shells of similar norm first, so that no few long vectors loosen the bound of the others.
Vectors are dealt to shards by the nearest of some pivots. A query is searched in its nearest shard first; its 20th product
there rules out the shards that are further than their radius allows, and inside a shard the branches of its tree. ``factor``
multiplies the lower bounds of chords before they are compared: 1 is exact search, more prunes more. Some queries are also
compared with every vector; if too many of their neighbours are missing, all are searched again with half the factor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillspark.session import materialise

SHARD_ROWS = 8192
BLOCK_QUERIES = 8192  # that one task searches in one shard
PIVOT_SAMPLE = 20_000  # vectors from which pivots are taken, at most
LEAF = 128
SHELL = 1.25  # largest by smallest norm in a shell
SHELLS = 32  # the last one holds all shorter vectors
CHECKED = 256  # queries that are compared with every vector, by hash of the id
RECALL = 0.95  # of their neighbours that must be found


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """id, vector (floats) of the rows that take part: with an id, no null or non-finite component, not zero, and of the
    length that most such vectors have (the shorter one if two are as frequent)."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).cast("array<float>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & (F.size("vector") > 0) & ~bad & F.exists("vector", lambda x: x != 0))
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (length["n"] if length else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def _chords(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """From the direction of each row to each pivot."""
    return np.sqrt(np.maximum(2 - 2 * (x / _norms(x)[:, None]) @ pivots.T, 0))


def _reach(least: np.ndarray, norms: np.ndarray, top, low) -> np.ndarray:
    """Square of the longest chord at which vectors with norms from ``low`` to ``top`` have a product of ``least`` with queries
    of these norms; negative where none has."""
    need = least / norms
    return 2 - 2 * np.where(need >= 0, need / top, need / low) + 1e-9


@dataclass
class _Node:
    point: np.ndarray | None = None  # vantage point
    border: float = 0.0
    sides: tuple = ()  # (node, least distance, largest distance) inside and outside
    rows: np.ndarray | None = None  # of a leaf


class VantageTree:
    """Vantage-point trees over the directions of the rows of ``x``, one a shell of norms; searched for many queries at once."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids = x, ids
        norms = _norms(x)
        self.unit = x / norms[:, None]
        shell = np.minimum(np.log(norms.max() / norms) / np.log(SHELL), SHELLS - 1).astype(int)
        rng = np.random.default_rng(len(x))
        shells = [np.flatnonzero(shell == k) for k in np.unique(shell)]
        self.shells = [(self._build(rows, rng), float(norms[rows].max()), float(norms[rows].min())) for rows in shells]

    def _build(self, rows: np.ndarray, rng) -> _Node:
        if len(rows) <= LEAF:
            return _Node(rows=rows)
        point = self.unit[rng.choice(rows)]
        far = np.sqrt(((self.unit[rows] - point) ** 2).sum(axis=1))
        order = np.argsort(far, kind="stable")
        half = len(rows) // 2
        parts = (order[:half], order[half:])
        sides = tuple((self._build(rows[p], rng), float(far[p].min()), float(far[p].max())) for p in parts)
        return _Node(point=point, border=float(far[order[half]]), sides=sides)

    def search(self, queries: np.ndarray, least: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Scores and rows of the ``k`` largest products of each query, best first; ties by smaller id; -1 where there are fewer.

        ``least`` holds products below which nothing is asked for.
        """
        scores, found = np.full((len(queries), k), -np.inf), np.full((len(queries), k), -1)
        norms, least = _norms(queries), least.copy()
        unit = queries / norms[:, None]

        def leaf(rows, q):
            product = queries[q] @ self.x[rows].T
            s = np.concatenate([scores[q], product], axis=1)
            at = np.concatenate([found[q], np.broadcast_to(rows, product.shape)], axis=1)
            ids = np.where(at >= 0, self.ids[at], np.iinfo(np.int64).max)
            order = np.lexsort((ids, -s), axis=1)[:, :k]
            scores[q], found[q] = np.take_along_axis(s, order, 1), np.take_along_axis(at, order, 1)
            least[q] = np.maximum(least[q], scores[q, -1])

        def visit(node, q, top, low):
            if not len(q):
                return
            if node.rows is not None:
                leaf(node.rows, q)
                return
            d = np.sqrt(((unit[q] - node.point) ** 2).sum(axis=1))
            for near, sides in ((d < node.border, node.sides), (d >= node.border, node.sides[::-1])):
                mine, far = q[near], d[near]
                for child, nearest, largest in sides:
                    bound = np.maximum(np.maximum(nearest - far, far - largest), 0)
                    ok = (bound * factor) ** 2 <= _reach(least[mine], norms[mine], top, low)
                    visit(child, mine[ok], top, low)

        for node, top, low in self.shells:
            visit(node, np.flatnonzero(_reach(least, norms, top, low) >= 0), top, low)
        return scores, found


def _search(batches: Iterator[pa.RecordBatch], k: int, factor: float) -> Iterator[pa.RecordBatch]:
    """Rows come by shard and part, vectors before queries: build the tree, then search."""
    schema = pa.schema([("query_id", pa.int64()), ("shard", pa.int32()), ("scores", pa.list_(pa.float64())), ("ids", pa.list_(pa.list_(pa.int64())))])
    now, vectors, members, tree = None, [], [], None

    def answers(rows: pa.RecordBatch):
        scores, found = tree.search(_matrix(rows.column("vector")), rows.column("least").to_numpy(), k, factor)
        keep = found >= 0
        return pa.RecordBatch.from_arrays(
            [
                rows.column("id"), rows.column("shard"), pa.array([s[o].tolist() for s, o in zip(scores, keep)], schema.field("scores").type),
                pa.array([[members[i] for i in f[o]] for f, o in zip(found, keep)], schema.field("ids").type),
            ], schema=schema,
        )

    for batch in batches:
        key = np.stack([batch.column(c).to_numpy() for c in ("shard", "part", "kind")], 1)
        cuts = np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1))) if len(key) else [], len(key)).astype(int)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            rows, place = batch.slice(a, b - a), tuple(key[a, :2])
            if place != now:
                now, vectors, members, tree = place, [], [], None
            if key[a, 2] == 0:
                vectors.append(_matrix(rows.column("vector")))
                members += rows.column("ids").to_pylist()
            elif members:
                if tree is None:
                    tree = VantageTree(np.concatenate(vectors), np.array([m[0] for m in members]))
                for lo in range(0, len(rows), 512):
                    yield answers(rows.slice(lo, 512))


def _compared(batches: Iterator[pa.RecordBatch], ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` vectors of a task with the largest products for each query, without a tree."""
    scores, names = np.empty((len(queries), 0)), []
    for batch in batches:
        for lo in range(0, len(batch), 4096):
            part = batch.slice(lo, 4096)
            scores = np.concatenate([scores, queries @ _matrix(part.column("vector")).T], axis=1)
            names = [*names, *part.column("ids").to_pylist()]
            if len(names) > k:
                best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                some = np.unique(best)  # of any query
                scores, names = scores[:, some], [names[i] for i in some.tolist()]
    for q, row in zip(ids.tolist(), scores):
        best = np.argsort(-row, kind="stable")[:k]
        yield pa.RecordBatch.from_arrays(
            [pa.array([q] * len(best), pa.int64()), pa.array(row[best]), pa.array([names[i] for i in best.tolist()], pa.list_(pa.int64()))],
            names=["query_id", "score", "ids"],
        )


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` vectors with the largest inner product for each query, other than itself.

    Rows that ``usable`` leaves out take no part on either side. Ties go to the smaller vec_id; with fewer candidates all are
    returned. Scores are in double precision. Equal vectors are one point of a tree with its ``k`` + 1 smallest ids, which are
    all that any answer can hold. Rows that repeat an id with equal vectors are one; with different vectors each is a candidate
    and a query of its own, and an id never answers itself. Other columns are not read; no rows give no rows. With a ``factor``
    above 1 neighbours can be missing: it is halved, down to 1 at the least, until ``CHECKED`` queries, compared with every
    vector, miss no more than 1 - ``RECALL`` of theirs.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding).distinct()
    asked = usable(queries, vec_id, embedding).distinct()
    by_vector = Window.partitionBy("vector").orderBy("id")
    few = rows.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)
    points = materialise(few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    n = points.count()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    shards = -(-n // SHARD_ROWS)
    sample = points.select(F.xxhash64("vector").alias("h"), "vector").orderBy("h").limit(min(PIVOT_SAMPLE, shards))
    chosen = np.array([r["vector"] for r in sample.collect()], float)
    pivots = spark.sparkContext.broadcast(chosen / _norms(chosen)[:, None])

    def placed(batches):
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                part = batch.slice(lo, 4096)
                x = _matrix(part.column("vector"))
                d = _chords(x, pivots.value)
                near = d.argmin(axis=1)
                columns = [*part.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near]), pa.array(_norms(x))]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "pivot", "far", "norm"])

    cells = materialise(points.mapInArrow(placed, "vector array<float>, ids array<bigint>, pivot int, far double, norm double"))
    of_cells = (F.count("*").alias("n"), F.max("far").alias("radius"), F.max("norm").alias("top"), F.min("norm").alias("low"))
    sizes = {r["pivot"]: r for r in cells.groupBy("pivot").agg(*of_cells).collect()}
    split = {p: -(-r["n"] // SHARD_ROWS) for p, r in sizes.items()}  # a crowded cell is several shards
    first, at = {}, 0
    for p in sorted(split):
        first[p], at = at, at + split[p]
    home = spark.createDataFrame([(p, first[p], split[p]) for p in first], "pivot int, first int, split int")
    points = materialise(
        cells.join(F.broadcast(home), "pivot").select((F.col("first") + F.pmod(F.xxhash64("vector"), "split")).cast("int").alias("shard"), "vector", "ids")
    )
    every_shard = [p for p in sorted(split) for _ in range(split[p])]
    layout = spark.sparkContext.broadcast((every_shard, *([sizes[p][c] for p in every_shard] for c in ("radius", "top", "low"))))

    def routed(batches, again: bool, factor: float):
        """Shards to search: the nearest ones at first; then those that the products so far don't rule out."""
        of, radius, top, low = (np.array(x) for x in layout.value)
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                q = _matrix(part.column("vector"))
                d = _chords(q, pivots.value[of])
                near = d <= d.min(axis=1, keepdims=True)
                if again:
                    least = part.column("least").to_numpy()
                    go = ~near & ((np.maximum(d - radius, 0) * factor) ** 2 <= _reach(least[:, None], _norms(q)[:, None], top, low))
                else:
                    least, go = np.full(len(q), -np.inf), near
                row, shard = np.nonzero(go)
                picked = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.astype(np.int32)), picked.column("id"), pa.array(least[row]), picked.column("vector")], names=["shard", "id", "least", "vector"]
                )

    def found(df: DataFrame, again: bool, factor: float) -> DataFrame:
        sent = materialise(df.mapInArrow(lambda b: routed(b, again, factor), "shard int, id bigint, least double, vector array<float>"))
        load = {r["shard"]: -(-r["count"] // BLOCK_QUERIES) for r in sent.groupBy("shard").count().collect()}
        parts = spark.createDataFrame(list(load.items()), "shard int, parts int")
        ask = sent.join(F.broadcast(parts), "shard").select(
            "shard", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.lit(1).alias("kind"), "id", "least", "vector", F.lit(None).cast("array<bigint>").alias("ids")
        )
        have = points.join(F.broadcast(parts), "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        have = have.select("shard", "part", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("id"), F.lit(0.0).alias("least"), "vector", "ids")
        both = have.unionByName(ask).repartition("shard", "part").sortWithinPartitions("shard", "part", "kind")
        hits = both.mapInArrow(lambda b: _search(b, k + 1, factor), "query_id bigint, shard int, scores array<double>, ids array<array<bigint>>")
        return materialise(hits)

    def ranked(scored: DataFrame) -> DataFrame:
        every = scored.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id != query_id")
        every = every.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def searched(factor: float) -> DataFrame:
        one = found(asked, again=False, factor=factor)
        pairs = one.select("query_id", F.posexplode("scores").alias("place", "score"))
        last = pairs.where(F.col("place") == k).groupBy("query_id").agg(F.max("score").alias("least"))
        own = asked.join(last, F.col("id") == F.col("query_id"), "left")
        two = found(own.select("id", "vector", F.coalesce("least", F.lit(float("-inf"))).alias("least")), again=True, factor=factor)
        every = one.unionByName(two).select("query_id", F.explode(F.arrays_zip("scores", "ids")).alias("x"))
        return ranked(every.select("query_id", F.col("x.scores").alias("score"), F.col("x.ids").alias("ids")))

    if factor <= 1:
        return searched(factor)
    some = asked.orderBy(F.xxhash64("id"), "id", "vector").limit(CHECKED).collect()
    if not some:
        return searched(1.0)
    mine = spark.sparkContext.broadcast((np.array([r["id"] for r in some]), np.array([r["vector"] for r in some], float)))
    of_task = points.select("vector", "ids").mapInArrow(lambda b: _compared(b, *mine.value, k + 1), "query_id bigint, score double, ids array<bigint>")
    true = materialise(ranked(of_task).groupBy(F.col("query_id").alias("of")).agg(F.min("score").alias("last"), F.count("*").alias("n")))
    wanted = true.agg(F.sum("n")).first()[0] or 0
    while True:
        result = searched(factor)
        good = result.join(F.broadcast(true), F.col("query_id") == F.col("of")).where(F.col("score") >= F.col("last") - 1e-9 * F.abs("last"))
        if factor <= 1 or good.count() >= RECALL * wanted:
            return result
        factor = max(1.0, factor / 2)
