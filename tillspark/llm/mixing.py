"""Mixing sources to target weights, with DataFrame operations only.

Documents get a hash-random key. Within each source they are sorted by it, in key ranges that many tasks share; running
sums of word counts inside a range plus the sum of the ranges before it place every document on its source's word axis, and
the source is cut at its exact budget. A budget above the source's size repeats whole epochs first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillspark.llm import text as T
from tillspark.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
RANGE_ROWS = 1024  # documents that one key range holds on average, or the root of their number if that is more
FEW_SOURCES = 50_000  # a table of at most so many sources is sent to all tasks
_ORDER = 1 << 32


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def random_key(doc_id: str, seed: int) -> Column:
    """Hash of the id, followed by the id: a random but repeatable order of documents."""
    named = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.concat(F.md5(F.concat(named, F.lit(f":{seed}"))), F.lit(":"), named)


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """Words that each source gets: source, source_size -> target, budget, epochs, rest.

    The weights go round the sources in code-point order (null last). All words times ``share`` are divided by weight; a
    target stops at ``cap`` times its source, and what is above it goes to the others by weight until none is above. Sources
    are filled in the order of limit by weight, so one pass of running sums finds the level. One row a source: the windows
    here have no key.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int"))
    limited = sources.select("source", "source_size", weight.cast("bigint").alias("weight"), (F.col("source_size") * cap).alias("limit"))
    fill = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * F.lit(float(share))
    full = F.coalesce(F.sum("limit").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    levels = limited.withColumn("level", (total - full) / open_weight)
    # levels fall from the first source below its limit on, as later ones count sources as full that aren't
    first_open = F.max(F.when(F.col("weight") * F.col("level") <= F.col("limit"), F.col("level"))).over(every)
    target = F.coalesce(F.least(F.col("limit").cast("double"), F.col("weight") * first_open), F.col("limit").cast("double"))
    budget = F.floor(F.col("target") + 0.5).cast("bigint")
    some = F.col("source_size") > 0
    return (
        levels.withColumn("target", target)
        .withColumn("budget", budget)
        .select(
            "source",
            "source_size",
            "target",
            F.when(some, F.expr("budget div source_size")).otherwise(0).alias("epochs"),
            F.when(some, F.col("budget") % F.nullif(F.col("source_size"), F.lit(0))).otherwise(0).alias("rest"),
        )
    )


def _placed(sized: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """``sized`` (source, size, key, ...) with its source's figures and ``before``, the source's words ahead of it."""
    rows = sized.count()
    ranges = 1 + rows // max(RANGE_ROWS, math.isqrt(rows))
    spot = F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint")
    cells = sized.withColumn("cell", F.floor(spot * ranges / _ORDER).cast("bigint"))
    sums = cells.groupBy("source", "cell").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(whole, weights, share, cap).withColumnRenamed("source", "of")
    offsets = sums.select("source", "cell", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    offsets = offsets.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    within = Window.partitionBy("source", "cell").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    summed = cells.withColumn("upto", F.sum("size").over(within)).withColumnsRenamed({"source": "own", "cell": "own_cell"})
    placed = summed.join(offsets, F.col("own").eqNullSafe(F.col("source")) & (F.col("own_cell") == F.col("cell")))
    return placed.withColumn("before", F.col("ahead") + F.col("upto") - F.col("size"))


def mixed_words(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, seed: int = 0
) -> DataFrame:
    """Words taken of each document: doc_id, size, source_size, target, taken.

    ``docs`` has doc_id, text and source; further columns are not read. Every source's taken words add up to its target,
    rounded: the document on the cut gives only its share of words. No document gives more than ``cap`` times its size. A
    null or empty text has size 0 and gives 0; a null source is a source of its own, last in order; a null doc_id is sorted
    by an empty name. Repeated rows are documents of their own; where they tie, the order among them doesn't change the
    result. No rows give no rows.
    """
    sized = materialise(docs.select("doc_id", "source", word_count("text").alias("size"), random_key("doc_id", seed).alias("key")))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    taken = F.col("epochs") * F.col("size") + part
    return _placed(sized, weights, share, cap).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, seed: int = 0) -> DataFrame:
    """The mix itself: rows of ``docs``, all columns unchanged, each as often as it is taken.

    As ``mixed_words``, but of whole documents: one is in the last epoch if at least half of its words are inside the budget,
    so a source misses its target by at most half a document. Each source's last key decides, which leaves the texts where
    they are: only word counts are shuffled. Rows that share a doc_id in one source stay or go together.
    """
    sized = materialise(docs.select("source", word_count("text").alias("size"), random_key("doc_id", seed).alias("key")))
    placed = _placed(sized, weights, share, cap)
    inside = 2 * F.col("before") + F.col("size") <= 2 * F.col("rest")
    cuts = placed.groupBy(F.col("source").alias("cut_source")).agg(
        F.max("epochs").alias("epochs"), F.max(F.when(inside, F.col("key"))).alias("last")
    )
    cuts = materialise(cuts)
    names = {c: T.fresh(docs, f"mix_{c}") for c in cuts.columns}
    cuts = cuts.withColumnsRenamed(names)
    if cuts.count() <= FEW_SOURCES:
        cuts = F.broadcast(cuts)
    chosen = docs.join(cuts, docs["source"].eqNullSafe(F.col(names["cut_source"])))
    more = F.when(random_key("doc_id", seed) <= F.col(names["last"]), 1).otherwise(0)
    copies = (F.col(names["epochs"]) + F.coalesce(more, F.lit(0))).cast("int")
    repeat = F.explode(F.array_repeat(F.lit(True), copies)).alias(T.fresh(docs, "mix_copy"))
    return chosen.select(*docs.columns, repeat).select(*docs.columns)
