"""Descriptive statistics and regression metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillspark.functions import exprs as X
from tillspark.operators import ordering


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, exact quartiles, sample deviation, bias-corrected skewness and excess kurtosis, and missing values.

    Everything comes from one table of value counts, nulls included, so the rows are scanned once.
    """
    every = ordering.value_counts(df, columns, keep_nulls=True)
    counts = every.filter(F.col("value").isNotNull())
    quartiles = ordering.quantiles(counts, {"q1": 0.25, "median": 0.5, "q3": 0.75}).drop("rows")
    n = F.col("rows").cast("double")
    g1 = F.try_divide(F.col("m3") / n, F.pow(F.col("m2") / n, F.lit(1.5)))
    g2 = F.try_divide(F.col("m4") / n, F.pow(F.col("m2") / n, F.lit(2))) - 3
    skew = F.try_divide(F.sqrt(n * (n - 1)), n - 2) * g1
    kurt = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    empty = F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0))
    missing = every.groupBy("metric").agg(F.sum("n").alias("_all"), empty.alias("missing_values"))
    joined = missing.join(ordering.moments(counts), "metric", "left").join(quartiles, "metric", "left")
    return joined.select(
        "metric",
        "mean",
        "median",
        F.sqrt(F.try_divide("m2", n - 1)).alias("std_dev"),
        "min",
        "max",
        "q1",
        "q3",
        (F.col("q3") - F.col("q1")).alias("iqr"),
        skew.alias("skewness"),
        kurt.alias("kurtosis"),
        "missing_values",
        X.ratio(F.col("missing_values") * 100, "_all").alias("missing_pct"),
    )


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson matrix in long form, every pair from one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    names = {pair: f"_{i}" for i, pair in enumerate(pairs)}
    figures = df.agg(*(F.corr(X.double(a), X.double(b)).alias(names[a, b]) for a, b in pairs))
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(names.get((a, b)) or names[b, a]).alias("r"))
        for a in columns
        for b in columns
    ]
    return figures.select(F.inline(F.array(*cells)))


EPSILON = 2.220446049250313e-16  # fixed value: smallest denominator of a percentage error


def metric_columns(actual: str = "y", predicted: str = "prediction") -> list[Column]:
    """MAE, RMSE, MAPE and R2 as plain aggregates."""
    y, p = X.double(actual), X.double(predicted)
    error = y - p
    return [
        X.rows().alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error) / F.greatest(F.abs(y), F.lit(EPSILON))).alias("mape"),
        (1 - F.try_divide(F.sum(error * error), F.regr_syy(y, y))).alias("r2"),
    ]


def regression_metrics(df: DataFrame, actual: str = "y", predicted: str = "prediction", keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(*metric_columns(actual, predicted))
