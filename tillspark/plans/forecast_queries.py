"""Stationarity, seasonal ARIMA and additive forecasts over the monthly series of the sales table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillspark.functions import exprs as X
from tillspark.operators import forecast, series, stats
from tillspark.plans.kpi_queries import monthly
from tillspark.plans.model_queries import once
from tillspark.plans.registry import query
from tillspark.session import materialise, scratch_path
from tillspark.sources.star import sales

KEYS = ("category",)


def total_series(spark, d):
    return series.month_series(monthly(spark, d))


def category_series(spark, d):
    """Monthly series per category; checkpointed, as fitting, scoring and refitting read it in turn."""

    def make():
        lines = sales(spark, d, "category", "date_of_sale", "total_amount")
        return materialise(series.month_series(series.monthly_totals(lines, KEYS), KEYS))

    return once(spark, d, "category series", make)


@query("ts_adf")
def ts_adf(spark, d):
    return forecast.stationarity(total_series(spark, d))


@query("ts_adf_by_category")
def ts_adf_by_category(spark, d):
    return forecast.stationarity(category_series(spark, d), KEYS)


@query("ts_pacf")
def ts_pacf(spark, d):
    return forecast.partial_autocorrelation(series.autocorrelation(total_series(spark, d)))


@query("ts_pacf_by_category")
def ts_pacf_by_category(spark, d):
    return forecast.partial_autocorrelation(series.autocorrelation(category_series(spark, d), KEYS), KEYS)


def sarima_grid(spark, d):
    return once(spark, d, "sarima", lambda: materialise(forecast.sarima_grid(category_series(spark, d), KEYS)))


def sarima_selected(spark, d):
    return forecast.sarima_select(forecast.sarima_scores(sarima_grid(spark, d), KEYS), category_series(spark, d), KEYS)


@query("fc_sarima")
def fc_sarima(spark, d):
    """Best of 90 candidates for each category."""
    return sarima_selected(spark, d)


@query("fc_sarima_test")
def fc_sarima_test(spark, d):
    """The chosen candidate's forecast of the held-out months, with its 95% interval."""
    chosen = sarima_selected(spark, d).select(*KEYS, "order")
    return sarima_grid(spark, d).join(chosen, [*KEYS, "order"])


@query("fc_sarima_validated")
def fc_sarima_validated(spark, d):
    """Chosen on rolling windows before the test months, scored on the test months."""
    return forecast.sarima_validated(category_series(spark, d), KEYS)


def stored(spark, name, models):
    """A table of models as a reader finds it: written as a version, and read back."""
    path = scratch_path(spark, name)
    forecast.save_models(models, path, 1)
    return forecast.load_models(spark, path)


@query("fc_sarima_future")
def fc_sarima_future(spark, d):
    """Forecast from stored coefficients; nothing is fitted after the table has been written."""
    models = forecast.sarima_models(category_series(spark, d), sarima_selected(spark, d), KEYS)
    return forecast.sarima_ahead(stored(spark, "sarima-models", models), KEYS, 12)


def distance(a, b):
    """Points of two forecasts and how far they are apart at most."""
    pairs = a.alias("a").join(b.alias("b"), [*KEYS, "ds"])
    apart = [F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) / F.greatest(F.abs(F.col(f"b.{c}")), F.lit(1.0)) for c in ("forecast", "lower_bound", "upper_bound")]
    return pairs.groupBy(*KEYS).agg(X.rows().alias("points"), F.max(F.greatest(*apart)).alias("largest_difference"))


@query("snk_model_sarima")
def snk_model_sarima(spark, d):
    """Forecasts of the stored ARIMA models against models that are fitted anew."""
    series_, chosen = category_series(spark, d), sarima_selected(spark, d)
    saved = forecast.sarima_ahead(stored(spark, "sarima-models", forecast.sarima_models(series_, chosen, KEYS)), KEYS, 12)
    return distance(saved, forecast.sarima_future(series_, chosen, KEYS, 12))


@query("snk_model_additive")
def snk_model_additive(spark, d):
    """Forecasts of the stored additive models against models that are fitted anew."""
    saved = forecast.additive_ahead(stored(spark, "additive-models", forecast.additive_models(category_series(spark, d), KEYS)), KEYS, 24)
    return distance(saved, forecast.additive_forecast(category_series(spark, d), KEYS, 24))


@query("fc_sarima_total")
def fc_sarima_total(spark, d):
    """One series: the whole company."""
    months = materialise(total_series(spark, d))
    return forecast.sarima_select(forecast.sarima_scores(forecast.sarima_grid(months)), months)


@query("fc_additive")
def fc_additive(spark, d):
    return forecast.additive_forecast(category_series(spark, d), KEYS, 24)


@query("fc_additive_daily")
def fc_additive_daily(spark, d):
    """Days instead of months, without components."""
    return forecast.additive_forecast(total_series(spark, d), horizon=30, freq="D", components=False)


def backtest_scores(spark, d):
    """Errors of each series; one that is too short has no months to score and null errors."""
    return stats.regression_metrics(forecast.additive_backtest(category_series(spark, d), KEYS), "y", "forecast", KEYS)


@query("fc_backtest")
def fc_backtest(spark, d):
    return backtest_scores(spark, d)


@query("fc_compare")
def fc_compare(spark, d):
    scores = {"SARIMA": sarima_selected(spark, d), "Additive": backtest_scores(spark, d)}
    return forecast.compare_models(scores, KEYS)


@query("agg_month_by_category", """SELECT category, last_day(d) AS ds, CAST(sum(total_amount) AS DOUBLE) AS y FROM sales GROUP BY 1, 2""")
def agg_month_by_category(spark, d):
    """The months that do have sales, of the series behind the forecasts."""
    lines = sales(spark, d, "category", "date_of_sale", "total_amount")
    totals = series.monthly_totals(lines, KEYS)
    return totals.select("category", F.last_day(F.make_date("year", "month", F.lit(1))).alias("ds"), X.double("monthly_total").alias("y"))
