"""Daily and monthly series.

The fact is aggregated to one row per calendar day (or month) and series before any window runs, so the rows of a series are
bounded by the calendar whatever the size of the fact or the share of one series in it. Windows are partitioned by the
series keys; without keys there is one series. Every operator reads the fact once: nothing is joined back to it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillspark.functions import exprs as X

Keys = Sequence[str]


# ---- building the series ---------------------------------------------------------------------------------------------


def daily_totals(sales: DataFrame, keys: Keys = (), ts: str = "date_of_sale", amount: str = "total_amount") -> DataFrame:
    return sales.groupBy(*keys, X.as_date(ts).alias("sale_date")).agg(F.sum(amount).alias("daily_total"))


def monthly_totals(sales: DataFrame, keys: Keys = (), ts: str = "date_of_sale", amount: str = "total_amount") -> DataFrame:
    by = [F.year(ts).alias("year"), F.month(ts).alias("month")]
    return sales.groupBy(*keys, *by).agg(F.sum(amount).alias("monthly_total"))


def zero_fill(daily: DataFrame, keys: Keys = ()) -> DataFrame:
    """Complete calendar between the first and last day of each series, 0 on days without sales.

    Every row spawns the empty days up to the next observed one, which needs neither a calendar table nor a join.
    """
    following = F.lead("sale_date").over(Window.partitionBy(*keys).orderBy("sale_date"))
    last = F.coalesce(F.date_sub(following, 1), F.col("sale_date"))
    days = daily.withColumn("_days", F.sequence("sale_date", last)).select("*", F.explode("_days").alias("_day"))
    value = F.when(F.col("_day") == F.col("sale_date"), F.col("daily_total")).otherwise(0)
    return days.select(*keys, F.col("_day").alias("sale_date"), value.alias("daily_total"))


def month_series(monthly: DataFrame, keys: Keys = ()) -> DataFrame:
    """Regular month-end series ``(keys, ds, t, y)``; months without sales are 0 and ``t`` counts months."""
    index = F.col("year") * 12 + F.col("month") - 1
    following = F.lead(index).over(Window.partitionBy(*keys).orderBy(index))
    filled = monthly.withColumn("_first", index).withColumn("_next", F.coalesce(following - 1, index))
    spread = filled.select("*", F.explode(F.sequence("_first", "_next")).alias("t"))
    month_start = F.make_date(F.floor(F.col("t") / 12).cast("int"), (F.col("t") % 12 + 1).cast("int"), F.lit(1))
    value = F.when(F.col("t") == F.col("_first"), F.col("monthly_total")).otherwise(0)
    return spread.select(*keys, F.last_day(month_start).alias("ds"), "t", X.double(value).alias("y"))


def date_bounds(df: DataFrame, margin: int = 0, ts: str = "date_of_sale") -> tuple[str, str]:
    """First and last day as text, ``margin`` days further out; of an empty frame, the first day of 1970."""
    low, high = df.agg(F.min(X.as_date(ts)), F.max(X.as_date(ts))).first()
    low, high = low or dt.date(1970, 1, 1), high or dt.date(1970, 1, 1)
    step = dt.timedelta(days=margin)
    return (low - step).isoformat(), (high + step).isoformat()


def date_dimension(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Calendar table from ``start`` to ``end``, both included. ``is_holiday`` is declared but has no source."""
    bounds = spark.range(1).select(
        F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("date_id")
    )
    return calendar_columns(bounds, "date_id")


def calendar_columns(days: DataFrame, day: str) -> DataFrame:
    return days.select(
        day,
        F.year(day).alias("year"),
        F.month(day).alias("month"),
        F.dayofmonth(day).alias("day"),
        F.dayofweek(day).alias("day_of_week"),
        F.quarter(day).alias("quarter"),
        F.weekofyear(day).alias("week_of_year"),
        F.dayofweek(day).isin(1, 7).alias("is_weekend"),
        F.lit(None).cast("boolean").alias("is_holiday"),
    )


# ---- calendar frames: missing days are skipped, not counted as zero -----------------------------------------------------


def _by_day(keys: Keys, first: int, last: int):
    return Window.partitionBy(*keys).orderBy(F.unix_date("sale_date")).rangeBetween(first, last)


def moving_averages(daily: DataFrame, days: Sequence[int] = (7, 30), keys: Keys = ()) -> DataFrame:
    """Mean of the observed days among the last ``d`` calendar days, the current day included."""
    columns = [X.mean_over("daily_total", _by_day(keys, 1 - d, 0)).alias(f"moving_avg_{d}") for d in days]
    return daily.select(*keys, "sale_date", X.double("daily_total").alias("daily_sales"), *columns)


def lag_features(
    daily: DataFrame,
    lags: Sequence[int] = (1, 2, 3, 7, 14, 30),
    windows: Sequence[int] = (7, 30),
    keys: Keys = (),
) -> DataFrame:
    """Sales ``k`` calendar days earlier, and means over the previous ``w`` days without the current one."""
    lagged = [X.double(F.sum("daily_total").over(_by_day(keys, -k, -k))).alias(f"sales_lag{k}") for k in lags]
    means = [X.mean_over("daily_total", _by_day(keys, -w, -1)).alias(f"moving_avg_{w}day") for w in windows]
    return daily.select(*keys, "sale_date", X.double("daily_total").alias("daily_total"), *lagged, *means)


# ---- row frames: counted in observations ------------------------------------------------------------------------------


def rolling(df: DataFrame, order: str, value: str, size: int, keys: Keys = (), spread: bool = False) -> DataFrame:
    """Mean (and sample deviation) of the last ``size`` rows, null until the window is full."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - size, 0)
    full = F.count(value).over(w) == size
    out = df.withColumn(f"rolling_mean_{size}", F.when(full, X.mean_over(value, w)))
    if spread:
        out = out.withColumn(f"rolling_std_{size}", F.when(full, F.stddev_samp(X.double(value)).over(w)))
    return out


def difference(df: DataFrame, order: str, value: str, times: int = 1, keys: Keys = (), out: str = "diff") -> DataFrame:
    """``times``-fold first difference; the rows that lose their predecessor are dropped."""
    w = Window.partitionBy(*keys).orderBy(order)
    current = df.withColumn(out, F.col(value))
    for _ in range(times):
        current = current.withColumn(out, F.col(out) - F.lag(out).over(w)).filter(F.col(out).isNotNull())
    return current


def split_by_time(series: DataFrame, order: str = "ds", train_share: float = 0.8, keys: Keys = ()) -> DataFrame:
    """Mark the first ``floor(share * n)`` observations of each series as training rows."""
    w = Window.partitionBy(*keys)
    position = F.row_number().over(w.orderBy(order))
    cut = F.floor(F.count(F.lit(1)).over(w) * train_share)
    return series.withColumn("part", F.when(position <= cut, "train").otherwise("test"))


# ---- decomposition and autocorrelation --------------------------------------------------------------------------------


def decompose(series: DataFrame, keys: Keys = (), period: int = 12) -> DataFrame:
    """Multiplicative decomposition of a regular series ``(keys, ds, t, y)`` into trend, seasonal and residual.

    Trend is the centred moving average over one period (half weight at both ends when the period is even); the seasonal
    factors are the mean detrended values per position, scaled to average 1. Series that are shorter than two periods or not
    positive come back with their status and empty components.
    """
    whole = Window.partitionBy(*keys)
    ordered = whole.orderBy("t")
    half = period // 2
    inner = ordered.rowsBetween(-half + (period % 2 == 0), half - (period % 2 == 0))
    ends = (F.lag("y", half).over(ordered) + F.lead("y", half).over(ordered)) / 2
    full = F.lag("y", half).over(ordered).isNotNull() & F.lead("y", half).over(ordered).isNotNull()
    window_sum = F.sum("y").over(inner) + (ends if period % 2 == 0 else 0)

    status = (
        F.when(F.count("y").over(whole) < 2 * period, "too_short")
        .when(F.min("y").over(whole) <= 0, "not_positive")
        .otherwise("ok")
    )
    slot = whole_slot = Window.partitionBy(*keys, "_slot")
    base = series.withColumn("status", status).withColumn("_slot", F.col("t") % period)
    trend = base.withColumn("trend", F.when((F.col("status") == "ok") & full, window_sum / period))
    raw = trend.withColumn("_raw", F.avg(X.ratio("y", "trend")).over(slot)).withColumn(
        "_share", F.col("_raw") / F.count(F.lit(1)).over(whole_slot)
    )
    scaled = raw.withColumn("seasonal", F.col("_raw") / (F.sum("_share").over(whole) / period))
    return scaled.select(
        *keys, "ds", "t", "y", "status", "trend", "seasonal",
        X.ratio("y", F.col("trend") * F.col("seasonal")).alias("resid"),
    )


# Cuts for the verdict on the seasonal pattern.
STRONG, MODERATE = 0.6, 0.3


def pattern_strength(parts: DataFrame, keys: Keys = ()) -> DataFrame:
    """Share of variance explained by the seasonal and the trend component, with a verdict."""
    def strength(component: str) -> Column:
        return 1 - F.try_divide(F.var_pop("resid"), F.var_pop(F.col(component) + F.col("resid")))

    out = parts.groupBy(*keys, "status").agg(
        strength("seasonal").alias("seasonal_strength"), strength("trend").alias("trend_strength")
    )
    verdict = (
        F.when(F.col("seasonal_strength") > STRONG, "strong")
        .when(F.col("seasonal_strength") > MODERATE, "moderate")
        .when(F.col("seasonal_strength").isNotNull(), "weak")
    )
    return out.withColumn("verdict", verdict)


def autocorrelation(series: DataFrame, keys: Keys = (), max_lag: int = 24) -> DataFrame:
    """Autocorrelation for lags 0..min(max_lag, n/2) with Bartlett's 95% half-width.

    A series becomes one array (at most one value per month) and every lag is a product of two of its slices: no self-join,
    and a plan whose size does not grow with the number of lags.
    """

    gap = F.col("y") - F.avg("y").over(Window.partitionBy(*keys))
    rows = series.withColumn("_d", gap).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("t", "_d"))).alias("_p"),
        F.sum(F.col("_d") * F.col("_d")).alias("_ss"),
        F.count("_d").alias("n"),
    )
    squares = rows.select(*keys, "n", "_ss", F.col("_p._d").alias("_c"))

    def at_lag(k: Column) -> Column:
        length = F.size("_c") - k
        products = F.zip_with(F.slice("_c", F.lit(1), length), F.slice("_c", k + 1, length), lambda a, b: a * b)
        total = F.aggregate(products, F.lit(0.0), lambda so_far, v: so_far + v)
        return F.when(k == 0, 1.0).otherwise(F.try_divide(total, F.col("_ss")))

    lags = F.sequence(F.lit(0), F.least(F.lit(max_lag), F.floor(F.col("n") / 2).cast("int")))
    long = squares.select(*keys, "n", F.posexplode(F.transform(lags, at_lag)).alias("lag", "acf"))
    earlier = Window.partitionBy(*keys).orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(F.col("lag") > 0, F.col("acf") * F.col("acf"))).over(earlier), F.lit(0.0))
    width = F.when(F.col("lag") > 0, 1.96 * F.sqrt((1 + 2 * before) / F.col("n"))).otherwise(0.0)
    return long.withColumn("half_width", width)
