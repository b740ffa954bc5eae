"""Chat formatting of logged conversations, after collapsing cumulative snapshots.

A log that writes a conversation anew after every turn holds many prefixes of one conversation. Rolling hashes of turn
prefixes find them: a conversation goes when its whole hash is the prefix hash of a longer one, or of an equal one with a
smaller id. What stays is rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillspark.session import materialise

# Fixed markers of the ChatML layout
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turns(rows: DataFrame) -> DataFrame:
    """conv_id, place, role, text: distinct turns in order, numbered from 1."""
    turns = rows.select("conv_id", "turn", "role", "text").distinct()
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    return turns.withColumn("place", F.row_number().over(order))


def prefix_hashes(rows: DataFrame) -> DataFrame:
    """conv_id, place, low, high: a hash of each conversation's turns up to each place, rolled on by adding one turn.

    Two sums of 64-bit hashes of (place, role, text) with different seeds: equal prefixes have equal sums, and others, but for
    a chance of about 2**-128 a pair, have not. Sums are decimals, so they don't overflow.
    """
    upto = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    said = (F.col("place"), F.coalesce("role", F.lit("")), F.col("role").isNull(), F.coalesce("text", F.lit("")), F.col("text").isNull())

    def rolled(seed: int):
        return F.sum(F.xxhash64(F.lit(seed), *said).cast("decimal(20,0)")).over(upto)

    return _turns(rows).select("conv_id", "place", rolled(1).alias("low"), rolled(2).alias("high"))


def maximal(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies: conversations that are no prefix of a longer one, equal ones once, by the smallest conv_id.

    ``n_copies`` counts the equal ones. Equal conversations and prefixes are first made one row a task, so that a conversation
    or a first turn that a third of the log shares moves as a few rows.
    """
    hashes = materialise(prefix_hashes(rows))
    ends = hashes.groupBy("conv_id").agg(F.max_by(F.struct("place", "low", "high"), "place").alias("end"))
    whole = ends.groupBy("end.place", "end.low", "end.high").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    lengths = ends.select(F.col("conv_id").alias("of"), F.col("end.place").alias("n_turns"))
    inner = hashes.join(lengths, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("place") < F.col("n_turns")))
    inner = inner.select("place", "low", "high").distinct()
    return whole.join(inner, ["place", "low", "high"], "left_anti").select("conv_id", F.col("place").alias("n_turns"), "n_copies")


def formatted(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, text: the maximal conversations, each rendered as one text.

    ``rows`` has conv_id, turn, role and text; other columns are not read. Turns are ordered by ``turn`` (null last), then role
    and text; rows repeated as a whole are one turn. A null role is rendered as ``unknown``, a null text as an empty one; for
    collapsing, null differs from empty. Rows without conv_id are one conversation of that name. No rows give no rows.
    """
    kept = maximal(rows)
    turns = _turns(rows).withColumnRenamed("conv_id", "of")
    mine = turns.join(kept, F.col("of").eqNullSafe(F.col("conv_id")), "left_semi")
    line = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE + "\n"))
    lines = mine.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "")
    return kept.join(lines, F.col("conv_id").eqNullSafe(F.col("of"))).select("conv_id", "n_turns", "n_copies", text.alias("text"))
