"""Cleaning: parsing, coercion, imputation, calendar features, profiling and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillspark.functions import exprs as X
from tillspark.operators import ordering
from tillspark.schemas import NUMERIC_COLUMNS


def profile(df: DataFrame, approximate: bool = False, samples: int = 3, sample_by: Sequence[str] | None = None) -> DataFrame:
    """One row per column: type, rows, nulls, distinct values and ``samples`` values, in the order of the columns.

    The table is read once for the figures, whatever its width: cells go out as (column, 128-bit hash), equal ones combined
    map-side; with ``approximate`` a sketch a column takes the place of the count. The sampled rows are those with the smallest
    checksum of ``sample_by`` (all columns by default), so they don't depend on how the table is split.
    """
    kinds = dict(df.dtypes)
    cells = [
        F.struct(F.lit(i).alias("place"), F.xxhash64(c).alias("a"), F.xxhash64(F.lit(1), c).alias("b"), F.col(c).isNull().alias("missing"))
        for i, c in enumerate(df.columns)
    ]
    long = df.select(F.inline(F.array(*cells)))
    if approximate:
        counted = long.groupBy("place").agg(
            X.rows().alias("row_count"), F.count_if("missing").alias("null_count"), F.approx_count_distinct(F.when(~F.col("missing"), F.col("a"))).alias("distinct_count")
        )
    else:
        values = long.groupBy("place", "a", "b", "missing").agg(X.rows().alias("n"))
        counted = values.groupBy("place").agg(
            F.sum("n").alias("row_count"), F.coalesce(F.sum(F.when(F.col("missing"), F.col("n"))), F.lit(0)).alias("null_count"), F.count_if(~F.col("missing")).alias("distinct_count")
        )
    key = F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in (sample_by or df.columns))))
    shown = df.select(key.alias("_key"), F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in df.columns)).alias("_shown"))
    drawn = shown.orderBy("_key", "_shown").limit(samples).agg(F.sort_array(F.collect_list(F.struct("_key", "_shown"))).alias("s")).scalar()
    names = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("data_type")) for i, c in enumerate(df.columns)))
    columns = df.sparkSession.range(1).select(F.inline(names))
    told = columns.join(counted, "place", "left").withColumn("_drawn", drawn)
    told = told.withColumn("samples", F.array_join(F.transform("_drawn", lambda r: r["_shown"][F.col("place")]), " | "))
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("row_count", "null_count", "distinct_count")]
    return told.orderBy("place").select("column_name", "data_type", *zero, "samples")


def parse_timestamps(df: DataFrame, *columns: str) -> DataFrame:
    """Text to timestamp; text that is no date stops the job."""
    return df.withColumns({c: F.to_timestamp(c) for c in columns})


def calendar_features(df: DataFrame, ts: str = "date_of_sale") -> DataFrame:
    """Year, month, day, weekday (Monday = 0), quarter and ISO week."""
    return df.withColumns(
        {
            "year": F.year(ts),
            "month": F.month(ts),
            "day": F.dayofmonth(ts),
            "day_of_week": F.weekday(ts),
            "quarter": F.quarter(ts),
            "week_of_year": F.weekofyear(ts),
        }
    )


def to_numeric(df: DataFrame, columns: Sequence[str] = NUMERIC_COLUMNS) -> DataFrame:
    """Text to number; anything that is no number becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns if c in df.columns})


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the interpolated median of every column."""
    found = ordering.quantiles(ordering.value_counts(df, columns), {"median": 0.5})
    return found.agg(*(F.max(F.when(F.col("metric") == c, F.col("median"))).alias(c) for c in columns))


def impute_median(
    df: DataFrame, columns: Sequence[str] = NUMERIC_COLUMNS, fitted: DataFrame | None = None
) -> DataFrame:
    """Replace nulls by the column medians, those of ``fitted`` (a row from ``medians``) when given."""
    row = (fitted if fitted is not None else medians(df, columns)).select(F.struct(*columns))
    filled = {c: F.coalesce(X.double(c), F.col("_medians")[c]) for c in columns}
    return df.withColumn("_medians", row.scalar()).withColumns(filled).drop("_medians")


def drop_present(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*(c for c in columns if c in df.columns))


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({old: new for old, new in mapping.items() if old in df.columns})


def flat_aggregates(df: DataFrame, key: str, measures: dict[str, Sequence[str]]) -> DataFrame:
    """Several aggregates of several columns under flat names ``column_aggregate``."""
    kinds = {
        "sum": X.total, "mean": X.mean, "count": F.count,
        "min": lambda c: X.double(F.min(c)), "max": lambda c: X.double(F.max(c)),
    }
    columns = [kinds[m](c).alias(f"{c}_{m}") for c, wanted in measures.items() for m in wanted]
    return df.groupBy(key).agg(*columns)


def between_bounds(df: DataFrame, day: Column, other: DataFrame, other_day: Column) -> DataFrame:
    """Rows whose day lies between the first and the last day of another frame."""
    bounds = other.agg(F.struct(F.min(other_day).alias("low"), F.max(other_day).alias("high")))
    return (
        df.withColumn("_bounds", bounds.scalar())
        .filter(day.between(F.col("_bounds.low"), F.col("_bounds.high")))
        .drop("_bounds")
    )


def split_random(df: DataFrame, train_percent: int = 80, seed: int = 42) -> DataFrame:
    """Mark rows as train or test by a hash of their content: the same split however the rows are partitioned."""
    share = X.hash_fraction([c for c, kind in df.dtypes if not kind.startswith("map")], seed)
    return df.withColumn("part", F.when(share < train_percent, "train").otherwise("test"))
