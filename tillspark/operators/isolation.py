"""Isolation forest (Liu, Ting and Zhou, 2008) as Spark jobs.

Each tree sees at most 256 rows, chosen by a hash of row and tree, so a sample never depends on partitioning. Trees are grown
in parallel, one group per tree, each no larger than its sample. The finished forest is bounded by trees x 511 nodes; it is
broadcast and every row is scored where it lies. Forests of many keys are a table, joined to the rows of their key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillspark.functions import exprs as X
from tillspark.operators import ordering
from tillspark.session import materialise

SAMPLE = 256
EULER = 0.5772156649015329
NODES = "tree int, node int, left int, right int, feature int, threshold double, length double"
_STEPS = 1 << 30


def path_constant(n: float) -> float:
    """Average path length of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (np.log(n - 1) + EULER) - 2 * (n - 1) / n


def grow(points: np.ndarray, tree: int, seed: int) -> pd.DataFrame:
    """One isolation tree as a node table; a leaf holds its depth plus the expected depth of its unsplit points."""
    random = np.random.default_rng([seed, tree])
    limit = ceil(log2(max(len(points), 2)))
    nodes, stack = [], [(0, points, 0)]
    free = 1
    while stack:
        node, held, depth = stack.pop()
        low, high = held.min(axis=0), held.max(axis=0)
        wide = np.flatnonzero(high > low)
        if depth >= limit or len(wide) == 0:
            nodes.append((tree, node, -1, -1, -1, 0.0, depth + path_constant(len(held))))
            continue
        feature = int(random.choice(wide))
        cut = random.uniform(low[feature], high[feature])
        goes_left = held[:, feature] <= cut
        if goes_left.all():  # the cut fell on the upper bound
            goes_left = held[:, feature] < high[feature]
            cut = np.nextafter(high[feature], low[feature])
        nodes.append((tree, node, free, free + 1, feature, cut, 0.0))
        stack += [(free, held[goes_left], depth + 1), (free + 1, held[~goes_left], depth + 1)]
        free += 2
    return pd.DataFrame(nodes, columns=["tree", "node", "left", "right", "feature", "threshold", "length"])


def path_lengths(forest: Sequence[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Sum over the trees (left, right, feature, threshold, length by node) of how far each row of ``x`` comes."""
    depth, every = np.zeros(len(x)), np.arange(len(x))
    for tree in forest:
        at = np.zeros(len(x), dtype=int)
        while True:
            inner = tree[at, 0] >= 0
            if not inner.any():
                break
            feature = tree[at, 2].astype(int)
            left = x[every, np.maximum(feature, 0)] <= tree[at, 3]
            at = np.where(inner, np.where(left, tree[at, 0], tree[at, 1]).astype(int), at)
        depth += tree[at, 4]
    return depth


def sample_rows(df: DataFrame, ids: Sequence[str], trees: int, rows: int, seed: int, size: int = SAMPLE) -> DataFrame:
    """At most ``size`` rows per tree. Rows are thinned before they move, to about three times what is needed."""
    rate = min(1.0, 3 * size / max(rows, 1))

    def place(tree: Column) -> Column:
        return F.pmod(F.xxhash64(*ids, tree, F.lit(seed)), F.lit(_STEPS))

    chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: place(t) < F.lit(int(rate * _STEPS)))
    spread = df.select("*", F.explode(chosen).alias("tree"))
    spread = spread.withColumn("_place", place(F.col("tree")))
    first = Window.partitionBy("tree").orderBy("_place", *ids)
    return spread.withColumn("_position", F.row_number().over(first)).filter(F.col("_position") <= size)


def scores(
    df: DataFrame, features: Sequence[str], ids: Sequence[str], trees: int = 100, seed: int = 42
) -> DataFrame:
    """Rows with their anomaly score in (0, 1]; above one half is unusual. ``ids`` identify a row."""
    points = materialise(df.select(*df.columns))
    rows = points.count()
    columns = list(features)
    numbers = points.select(*ids, *(X.double(c).alias(f"_f{i}") for i, c in enumerate(columns)))
    sample = sample_rows(numbers, ids, trees, rows, seed)
    names = [f"_f{i}" for i in range(len(columns))]

    def build(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
        ordered = held.sort_values("_position")
        return grow(ordered[names].to_numpy(dtype=float), int(key[0]), seed)

    forest = sample.select("tree", "_position", *names).groupBy("tree").applyInPandas(build, NODES)
    table = forest.toPandas()  # bounded: trees x (2 * 256 - 1) nodes
    grown = [t.sort_values("node")[["left", "right", "feature", "threshold", "length"]].to_numpy() for _, t in table.groupby("tree")]
    shared = df.sparkSession.sparkContext.broadcast(grown)
    scale = path_constant(min(SAMPLE, rows)) or 1.0

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            depth = path_lengths(shared.value, batch[columns].to_numpy(dtype=float))
            yield batch.assign(score=2.0 ** (-depth / max(len(shared.value), 1) / scale))

    typed = points.withColumns({c: X.double(c) for c in columns})
    return typed.mapInPandas(score, typed.withColumn("score", F.lit(0.0)).schema)


# ---- many requests at once ---------------------------------------------------------------------------------------------

BLOCK = 50_000  # rows of a request that one task scores together; larger requests have several blocks


def grouped_scores(df: DataFrame, key: str, features: Sequence[str], ids: Sequence[str], trees: int = 100, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """``df`` with ``score`` by a forest of its own for each ``key``, the one that ``scores`` would grow for those rows alone.

    Trees are keyed by (key, tree), so the forests of all keys grow in one job. They are written as a table, of at most
    trees x 511 nodes a key, and joined to blocks of that key's rows: a key with a third of all rows is many blocks.
    ``key`` must not be null; other keys change nothing.
    """
    points = materialise(df)
    sizes = materialise(points.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")))
    names = [f"_f{i}" for i in range(len(features))]
    numbers = points.join(sizes, key).select(key, "_rows", *ids, *(X.double(c).alias(n) for c, n in zip(features, names)))

    def place(tree: Column) -> Column:
        return F.pmod(F.xxhash64(*ids, tree, F.lit(seed)), F.lit(_STEPS))

    rate = F.floor(F.least(F.lit(1.0), F.lit(3.0) * SAMPLE / F.col("_rows")) * _STEPS)
    chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: place(t) < rate)
    spread = numbers.select("*", F.explode(chosen).alias("tree")).withColumn("_place", place(F.col("tree")))
    first = Window.partitionBy(key, "tree").orderBy("_place", *ids)
    sample = spread.withColumn("_position", F.row_number().over(first)).filter(F.col("_position") <= SAMPLE)

    def build(keys: tuple, held: pd.DataFrame) -> pd.DataFrame:
        grown = grow(held.sort_values("_position")[names].to_numpy(dtype=float), int(keys[1]), seed)
        grown.insert(0, "_key", [keys[0]] * len(grown))
        return grown

    kind = df.schema[key].dataType.simpleString()
    forest = materialise(sample.select(key, "tree", "_position", *names).groupBy(key, "tree").applyInPandas(build, f"_key {kind}, {NODES}"))
    blocks = F.ceil(F.col("_rows") / block).cast("int")
    planted = forest.join(sizes, F.col("_key") == F.col(key)).select(forest["*"], F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_block"))
    typed = points.withColumns({c: X.double(c) for c in features}).join(sizes, key)
    typed = typed.withColumn("_block", F.pmod(F.xxhash64(*ids), blocks).cast("int"))
    schema = typed.drop("_block", "_rows").withColumn("score", F.lit(0.0)).schema

    def score(_: tuple, held: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        grown = [t.sort_values("node")[["left", "right", "feature", "threshold", "length"]].to_numpy() for _, t in nodes.groupby("tree")]
        depth = path_lengths(grown, held[list(features)].to_numpy(dtype=float))
        scale = path_constant(min(SAMPLE, int(held["_rows"].iloc[0]) if len(held) else 0)) or 1.0
        return held.drop(columns=["_block", "_rows"]).assign(score=2.0 ** (-depth / max(len(grown), 1) / scale))

    return typed.groupBy(key, "_block").cogroup(planted.groupBy("_key", "_block")).applyInPandas(score, schema)


def _cuts(scored: DataFrame, key: str, share: str) -> DataFrame:
    """For each key the score that the ``share`` of its rows (a column) is above, interpolated as ``ordering.quantiles`` does.

    Different scores of all keys are put in order together, and positions within a key are differences of running totals.
    """
    counts = materialise(scored.groupBy(key, "score").agg(F.count(F.lit(1)).alias("n"), F.first(share).alias("share")))
    placed = materialise(ordering.running_total(counts, [key, "score"], "n", "before"))
    sizes = placed.groupBy(key).agg(F.min("before").alias("start"), F.sum("n").alias("rows"))
    at = placed.join(sizes, key).withColumns({"low": F.col("before") - F.col("start"), "place": (F.col("rows") - 1) * (1 - F.col("share"))})
    inside = lambda r: F.max(F.when((F.col("low") < r) & (r <= F.col("low") + F.col("n")), F.col("score")))
    picked = at.groupBy(key, "rows", "place").agg(inside(F.floor("place") + 1).alias("a"), inside(F.ceil("place") + 1).alias("b"))
    return picked.select(key, "rows", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.floor("place"))).alias("cut"))


def detect(requests: DataFrame, default: DataFrame | None = None, trees: int = 100, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """Unusual days of many requests (request_id, sensitivity, records) in one job, each request judged by its own rows.

    ``records`` is JSON, a list of ``{"date", "sales"}``; a request whose records are null takes the rows of ``default`` (date,
    sales). Returns ``request_id, status, days, total_anomalies, date, sales, score``: a row for each flagged day, its date as
    ``yyyy-MM-dd``, and one row without a day for a request that has none. ``status`` is ``ok``, or ``bad_records`` if a record lacks
    a field or can't be read, ``bad_sensitivity`` outside (0, 0.5], ``no_records`` without rows. ``request_id`` is
    unique; requests without one are left out.
    """
    record = "array<struct<date string, sales double>>"
    parsed = F.from_json("records", record, {"mode": "PERMISSIVE"})
    if default is not None:
        days = F.struct(F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), X.double("sales").alias("sales"))
        parsed = F.when(F.col("records").isNull(), default.agg(F.sort_array(F.collect_list(days))).scalar()).otherwise(parsed)
    rows = F.transform("_r", lambda r, i: F.struct(F.try_to_timestamp(r["date"]).alias("date"), r["sales"].alias("sales"), i.alias("place")))
    asked = requests.filter(F.col("request_id").isNotNull()).select("request_id", X.double("sensitivity").alias("sensitivity"), "records", parsed.alias("_r"))
    asked = asked.withColumn("_rows", rows)
    broken = F.col("_rows").isNull() & F.col("records").isNotNull() | F.exists("_rows", lambda r: r["date"].isNull() | r["sales"].isNull() | F.isnan(r["sales"]))
    usable = F.col("sensitivity").isNotNull() & (F.col("sensitivity") > 0) & (F.col("sensitivity") <= 0.5)
    empty = F.coalesce(F.size("_rows"), F.lit(0)) <= 0
    status = F.when(~usable, "bad_sensitivity").when(broken, "bad_records").when(empty, "no_records").otherwise("ok")
    known = materialise(asked.withColumn("status", status).select("request_id", "status", "sensitivity", F.when(status == "ok", F.col("_rows")).alias("_rows")))
    points = known.select("request_id", "sensitivity", F.inline("_rows"))
    scored = materialise(grouped_scores(points, "request_id", ["sales"], ["date", "place"], trees, seed, block))
    cuts = _cuts(scored, "request_id", "sensitivity")
    flagged = scored.join(cuts, "request_id").filter(F.col("score") > F.col("cut"))
    totals = flagged.groupBy("request_id").agg(F.count(F.lit(1)).alias("total_anomalies"))
    sizes = cuts.select("request_id", F.col("rows").alias("days"))
    told = known.select("request_id", "status").join(sizes, "request_id", "left").join(totals, "request_id", "left")
    total = F.when(F.col("status") == "ok", F.coalesce("total_anomalies", F.lit(0)))
    out = told.withColumn("total_anomalies", total).join(flagged.select("request_id", "date", "sales", "score"), "request_id", "left")
    return out.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def isolation_anomalies(
    df: DataFrame,
    features: Sequence[str] = ("daily_total",),
    ids: Sequence[str] = ("sale_date",),
    contamination: float = 0.05,
    trees: int = 100,
    seed: int = 42,
    min_rows: int = 0,
) -> DataFrame:
    """Rows with ``score``, ``anomaly`` (1 for the ``contamination`` share with the highest scores, else 0) and ``status``.

    ``min_rows`` asks for more than that many rows; with fewer, ``status`` is ``too_few_rows`` and ``anomaly`` null.
    """
    scored = materialise(scores(df, features, ids, trees, seed))
    cut = ordering.quantiles(ordering.value_counts(scored, ["score"]), {"cut": 1 - contamination})
    bound = cut.select(F.struct("cut", "rows")).scalar()
    flagged = scored.withColumn("_bound", bound)
    enough = F.col("_bound.rows") > min_rows
    far = F.when(F.col("score") > F.col("_bound.cut"), 1).otherwise(0)
    status = F.when(enough, "ok").otherwise("too_few_rows")
    return flagged.withColumns({"anomaly": F.when(enough, far), "status": status}).drop("_bound")


def extremes(flagged: DataFrame, value: str = "daily_total", n: int = 5, ids: Sequence[str] = ("sale_date",)) -> DataFrame:
    """The ``n`` highest and ``n`` lowest flagged rows, ties by ``ids``."""
    found = flagged.filter(F.col("anomaly") == 1)
    high = found.orderBy(F.desc(value), *ids).limit(n).withColumn("side", F.lit("highest"))
    low = found.orderBy(value, *ids).limit(n).withColumn("side", F.lit("lowest"))
    return high.unionByName(low)
