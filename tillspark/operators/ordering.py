"""Global order without a single-partition sort.

Rows are range-partitioned on the whole sort key, so a hot value is split by the tie-break columns; positions inside a
range come from the partition-local sort, and each range is shifted by the number of rows in the ranges before it. The
range-partitioned rows are checkpointed: range bounds come from a sample, and both passes must see the same ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import ceil, floor, inf, nan

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillspark.session import materialise

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the in-partition row number in its lower 33 bits


def _ranges(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    # no fixed count: AQE merges small neighbouring ranges, which keeps their order
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    tagged = ranged.withColumn("_id", F.monotonically_increasing_id())
    split = tagged.select(
        *df.columns,
        F.shiftright("_id", _LOCAL_BITS).cast("int").alias("_range"),
        F.col("_id").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)).alias("_local"),
    )
    return materialise(split)


def _before(tagged: DataFrame, weight: Column) -> DataFrame:
    """Weight in all earlier ranges: one row per range, so its size is the number of shuffle partitions."""
    sums = tagged.groupBy("_range").agg(F.sum(weight).alias("_w"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_range", F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_offset"))


def row_number(df: DataFrame, order: Sequence[Column | str], out: str = "row_number") -> DataFrame:
    """Positions 1..n in a total order; end the order with a unique key."""
    tagged = _ranges(df, order)
    offsets = _before(tagged, F.lit(1))
    numbered = tagged.join(F.broadcast(offsets), "_range")
    return numbered.select(*df.columns, (F.col("_offset") + F.col("_local") + 1).alias(out))


def running_total(df: DataFrame, order: Sequence[Column | str], weight: str, out: str = "before") -> DataFrame:
    """Sum of ``weight`` over all rows that come strictly earlier in the order."""
    tagged = _ranges(df, order)
    offsets = _before(tagged, F.col(weight))
    inside = Window.partitionBy("_range").orderBy("_local").rowsBetween(Window.unboundedPreceding, -1)
    prefixed = tagged.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    joined = prefixed.join(F.broadcast(offsets), "_range")
    return joined.select(*df.columns, (F.col("_offset") + F.col("_inside")).alias(out))


def rank(df: DataFrame, order: Column, value: str, out: str = "rank") -> DataFrame:
    """Competition rank by ``value``: equal values, nulls among them, share the rank of the first of them.

    Rows lie in ranges of ``order`` and, within equal values, of their content, so a value held by many rows takes up several
    ranges and no task holds all of it. A rank is the first place of the value in its range, or in an earlier range that the
    value began in; only the first and the last value of a range can go on, two rows a range.
    """
    ties = [F.xxhash64(*df.columns)]
    tagged = _ranges(df, [order, *ties])
    placed = tagged.join(F.broadcast(_before(tagged, F.lit(1))), "_range").withColumn("_place", F.col("_offset") + F.col("_local") + 1)
    same = Window.partitionBy("_range", value)
    ends = placed.groupBy("_range").agg(F.array(F.min_by(F.struct(F.col(value).alias("of")), "_place"), F.max_by(F.struct(F.col(value).alias("of")), "_place")).alias("_ends"))
    edges = placed.join(F.broadcast(ends.select("_range", F.explode(F.array_distinct("_ends")).alias("_end"))), "_range")
    begun = edges.filter(F.col(value).eqNullSafe(F.col("_end.of"))).groupBy(F.struct(F.col(value).alias("of")).alias("_end")).agg(F.min("_place").alias("_begun"))
    local = placed.withColumn("_first", F.min("_place").over(same))
    known = local.join(F.broadcast(begun), F.col(value).eqNullSafe(F.col("_end.of")), "left")
    return known.select(*df.columns, F.least("_first", F.coalesce("_begun", "_first")).alias(out))


def tile(position: Column, rows: Column, tiles: int) -> Column:
    """Tile of a 1-based position: with ``rows = tiles * size + extra``, the first ``extra`` tiles hold one row more."""
    size = F.floor(rows / tiles)
    extra = rows % tiles
    wide = extra * (size + 1)
    in_wide = F.floor(F.try_divide(position - 1, size + 1)) + 1
    in_narrow = extra + F.floor(F.try_divide(position - 1 - wide, size)) + 1
    return F.when(position <= wide, in_wide).otherwise(in_narrow).cast("int")


def ntile(df: DataFrame, order: Sequence[Column | str], tiles: int, out: str = "tile") -> DataFrame:
    """Equal-sized tiles over a total order; end the order with a unique key."""
    numbered = row_number(df, order, "_position")
    rows = numbered.agg(F.count(F.lit(1))).scalar()
    return numbered.withColumn(out, tile(F.col("_position"), rows, tiles)).drop("_position")


def ntiles(df: DataFrame, key: str, scores: dict[str, Column], tiles: int) -> DataFrame:
    """Tiles by several ascending scores, ties by ``key`` (unique), from one range sort instead of one per score."""
    listed = list(scores.items())
    ranked = F.array(*(F.struct(F.lit(i).alias("_score"), v.cast("decimal(30,6)").alias("_value")) for i, (_, v) in enumerate(listed)))
    long = df.select("*", F.inline(ranked))
    numbered = row_number(long, ["_score", "_value", key], "_position")
    rows = numbered.filter(F.col("_score") == 0).agg(F.count(F.lit(1))).scalar()
    counted = numbered.withColumn("_rows", rows)
    position = F.col("_position") - F.col("_score") * F.col("_rows")
    tiled = counted.withColumn("_tile", tile(position, F.col("_rows"), tiles))
    picks = [F.max(F.when(F.col("_score") == i, F.col("_tile"))).alias(name) for i, (name, _) in enumerate(listed)]
    return tiled.groupBy(*df.columns).agg(*picks)


# ---- exact order statistics ------------------------------------------------------------------------------------------


# digits before and after the point that each exact type needs
_DIGITS = {"byte": (3, 0), "short": (5, 0), "integer": (10, 0), "long": (19, 0)}


def _common_type(df: DataFrame, columns: Sequence[str]) -> str:
    """Narrowest decimal that holds all columns (up to 18 digits Spark keeps it in a machine word), else double."""
    whole, fraction = 1, 0
    for c in columns:
        kind = df.schema[c].dataType
        if kind.typeName() == "decimal":
            digits = (kind.precision - kind.scale, kind.scale)
        elif kind.typeName() in _DIGITS:
            digits = _DIGITS[kind.typeName()]
        else:
            return "double"
        whole, fraction = max(whole, digits[0]), max(fraction, digits[1])
    return f"decimal({whole + fraction},{fraction})" if whole + fraction <= 38 else "double"


def value_counts(df: DataFrame, columns: Sequence[str], keep_nulls: bool = False) -> DataFrame:
    """The values of each column in long form: (metric, value, n), with n = 1.

    The columns are written once, as every statistic below reads them some times over. Nothing is shuffled: each statistic adds up
    within its map tasks, so neither values that are nearly all different nor hot ones move.
    """
    cast = _common_type(df, columns)
    narrow = materialise(df.select(*(F.col(c).cast(cast).alias(f"c{i}") for i, c in enumerate(columns))))
    pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(f"c{i}").alias("value"), F.lit(1).cast("bigint").alias("n")) for i, c in enumerate(columns)))
    long = narrow.select(F.inline(pairs))
    return long if keep_nulls else long.filter(F.col("value").isNotNull())


CELLS = 4096  # parts that an interval of values is cut into when a rank is looked for


def _cut(value: str, low: str, high: str) -> str:
    """SQL number of the part of an interval, 0 to CELLS - 1, that a value lies in; it never falls as values rise."""
    share = f"double({value} - {low}) / double({high} - {low})"
    wide = f"(double({value}) / 2 - double({low}) / 2) / (double({high}) / 2 - double({low}) / 2)"  # where the difference overflows
    return f"least({CELLS - 1}, int({CELLS} * if(double({high} - {low}) < double('inf'), {share}, {wide})))"


def order_statistics(counts: DataFrame, ranks: Callable[[int], dict[str, int]]) -> DataFrame:
    """Exact elements at given 1-based ranks, one row per metric; a rank outside 1..n gives null. Nothing is sorted.

    ``counts`` has metric, value and n (``value_counts``, or rows with n = 1); ``ranks`` maps the number of values to named
    ranks. The interval that holds a rank is cut into parts, whose rows are counted in one aggregation with their least and
    greatest values; the part that holds the rank is the next interval, until it holds one value. Each round reads the table once
    and brings back at most CELLS rows for each interval. Two or three rounds are the rule; values that differ by many orders of
    magnitude take one for every factor of CELLS. NaN counts as the greatest value, as when sorting.
    """
    value, kind = F.col("value"), counts.schema["value"].dataType
    special = kind.typeName() in ("double", "float")
    finite = value if not special else F.when(~F.isnan(value) & (F.abs(value) < inf), value)
    known = counts.filter(value.isNotNull()).groupBy("metric").agg(
        F.sum("n").alias("rows"), F.min(finite).alias("low"), F.max(finite).alias("high"), F.sum(F.when(finite.isNotNull(), F.col("n"))).alias("finite"),
        F.sum(F.when(value == -inf, F.col("n")) if special else F.lit(0)).alias("under"), F.sum(F.when(value == inf, F.col("n")) if special else F.lit(0)).alias("over"),
    ).collect()
    found: dict[tuple[str, str], object] = {}
    open_: dict[tuple, list[tuple]] = {}  # (metric, low, high, rows below) -> ranks looked for
    for r in known:
        under, within, over = r["under"] or 0, r["finite"] or 0, r["over"] or 0
        for name, rank in ranks(r["rows"]).items():
            if not 1 <= rank <= r["rows"]:
                found[r["metric"], name] = None
            elif rank <= under:
                found[r["metric"], name] = -inf
            elif rank > under + within:
                found[r["metric"], name] = inf if rank <= under + within + over else nan
            else:
                open_.setdefault((r["metric"], r["low"], r["high"], under), []).append((name, rank))
    while open_:
        for (metric, low, high, _), wanted in list(open_.items()):
            if low == high:
                found.update({(metric, name): low for name, _ in wanted})
        open_ = {k: v for k, v in open_.items() if k[1] != k[2]}
        if not open_:
            break
        intervals = list(open_)
        arms = []
        for i, (metric, low, high, _) in enumerate(intervals):
            a, b = (f"cast('{x!r}' as double)" if special else f"cast('{x}' as {kind.simpleString()})" for x in (low, high))
            name = metric.replace("\\", "\\\\").replace("'", "\\'")
            arms.append(f"when metric = '{name}' and value between {a} and {b} then named_struct('i', {i}, 'cell', {_cut('value', a, b)})")
        placed = counts.filter(finite.isNotNull()).select(F.expr(f"case {' '.join(arms)} end").alias("at"), "value", "n").filter("at is not null")
        cells = placed.groupBy("at.i", "at.cell").agg(F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).collect()
        held: dict[int, list] = {}
        for c in sorted(cells, key=lambda c: (c["i"], c["cell"])):
            held.setdefault(c["i"], []).append(c)
        narrower: dict[tuple, list[tuple]] = {}
        for i, own in held.items():
            metric, _, _, below = intervals[i]
            for c in own:
                inside = [(name, rank) for name, rank in open_[intervals[i]] if below < rank <= below + c["n"]]
                if inside:
                    narrower.setdefault((metric, c["low"], c["high"], below), []).extend(inside)
                below += c["n"]
        open_ = narrower
    names = list(ranks(1))
    rows = [(r["metric"], r["rows"], *(found[r["metric"], name] for name in names)) for r in known]
    schema = T.StructType([T.StructField("metric", T.StringType()), T.StructField("rows", T.LongType()), *(T.StructField(name, kind) for name in names)])
    return counts.sparkSession.createDataFrame(rows, schema)


def quantiles(counts: DataFrame, probabilities: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles (linear between neighbours), one row per metric."""

    def ranks(n: int) -> dict[str, int]:
        low = {f"{name}_low": floor((n - 1) * p) + 1 for name, p in probabilities.items()}
        high = {f"{name}_high": ceil((n - 1) * p) + 1 for name, p in probabilities.items()}
        return {**low, **high}

    picked = order_statistics(counts, ranks)
    out = []
    for name, p in probabilities.items():
        low, high = F.col(f"{name}_low").cast("double"), F.col(f"{name}_high").cast("double")
        place = (F.col("rows") - 1) * F.lit(p)
        out.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return picked.select("metric", "rows", *out)


def moments(counts: DataFrame) -> DataFrame:
    """Count, mean, range and central moment sums m2..m4 per metric, from the value counts."""
    v, n = F.col("value").cast("double"), F.col("n").cast("double")
    base = counts.groupBy("metric").agg(
        F.sum("n").alias("rows"),
        (F.sum(F.col("value") * F.col("n")).cast("double") / F.sum("n")).alias("mean"),
        F.min("value").cast("double").alias("min"),
        F.max("value").cast("double").alias("max"),
    )
    gap = v - F.col("mean")
    centred = counts.join(F.broadcast(base), "metric")  # one row per measured column
    powers = [F.sum(n * F.pow(gap, F.lit(k))).alias(f"m{k}") for k in (2, 3, 4)]
    return centred.groupBy("metric", "rows", "mean", "min", "max").agg(*powers)
