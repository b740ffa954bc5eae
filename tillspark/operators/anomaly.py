"""Unusual days: quartile fences and z-scores. Input is one row per day and series (see ``series.daily_totals``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillspark.functions import exprs as X

Keys = Sequence[str]


def zscores(daily: DataFrame, keys: Keys = ()) -> DataFrame:
    """Distance of each day from its series' mean in population standard deviations; null when all days are equal."""
    whole = Window.partitionBy(*keys)
    mean = X.mean_over("daily_total", whole)
    spread = F.stddev_pop(X.double("daily_total")).over(whole)
    return daily.withColumn("z_score", F.try_divide(X.double("daily_total") - mean, spread))


def zscore_anomalies(daily: DataFrame, threshold: float = 2.5, keys: Keys = ()) -> DataFrame:
    far = zscores(daily, keys).filter(F.abs("z_score") > threshold)
    return far.select(
        *keys, "sale_date", X.double("daily_total").alias("daily_total"), "z_score",
        F.lit("Anomaly").alias("anomaly_status"),
    ).orderBy(F.desc(F.abs("z_score")), *keys, "sale_date")


def _fences(q1: str = "first_quartile", q3: str = "third_quartile", factor: float = 1.5) -> dict:
    width = F.col(q3) - F.col(q1)
    return {
        "interquartile_range": width,
        "lower_bound": F.col(q1) - factor * width,
        "upper_bound": F.col(q3) + factor * width,
    }


def iqr_anomalies(daily: DataFrame, keys: Keys = (), factor: float = 1.5) -> DataFrame:
    """Days outside the quartile fences, the quartiles being the days ranked ``floor(n/4)`` and ``floor(3n/4)``.

    With fewer than four days there is no such first quartile, and nothing is reported.
    """
    whole = Window.partitionBy(*keys)
    total = X.double("daily_total")
    ranked = daily.withColumn("_rank", F.row_number().over(whole.orderBy("daily_total", "sale_date"))).withColumn(
        "_n", F.count(F.lit(1)).over(whole)
    )

    def element(share: float):
        return F.max(F.when(F.col("_rank") == F.floor(F.col("_n") * share), total)).over(whole)

    marked = ranked.withColumns({"first_quartile": element(0.25), "third_quartile": element(0.75)})
    marked = marked.withColumns(_fences(factor=factor)).withColumn("daily_total", total)
    status = F.when(F.col("daily_total") > F.col("upper_bound"), "High Outlier").when(
        F.col("daily_total") < F.col("lower_bound"), "Low Outlier"
    )
    return marked.withColumn("anomaly_status", status).filter(F.col("anomaly_status").isNotNull()).select(
        *keys, "sale_date", "daily_total", "anomaly_status", "first_quartile", "third_quartile",
        "interquartile_range", "lower_bound", "upper_bound",
    ).orderBy(*keys, "sale_date")


def iqr_bounds(daily: DataFrame, keys: Keys = (), factor: float = 1.5) -> DataFrame:
    """Fences from interpolated quartiles of the day totals, one row per series."""
    q = F.percentile(X.double("daily_total"), F.array(F.lit(0.25), F.lit(0.75)))
    quartiles = daily.groupBy(*keys).agg(q.alias("_q")).select(
        *keys, F.col("_q")[0].alias("first_quartile"), F.col("_q")[1].alias("third_quartile")
    )
    return quartiles.withColumns(_fences(factor=factor))
