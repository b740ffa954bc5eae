"""Decomposition, stationarity and forecasts on series with known answers."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillspark.functions import additive, arima, unitroot
from tillspark.operators import forecast, series, stats

FACTORS = np.array([0.8, 0.9, 1.0, 1.1, 1.2, 1.3, 1.2, 1.1, 1.0, 0.9, 0.8, 0.7])


def months_frame(spark, named):
    rows = []
    for name, values in named.items():
        for i, v in enumerate(values):
            t = 2018 * 12 + i
            first_of_next = dt.date((t + 1) // 12, (t + 1) % 12 + 1, 1)
            rows.append((name, first_of_next - dt.timedelta(days=1), t, float(v)))
    return spark.createDataFrame(rows, "s string, ds date, t int, y double")


@pytest.fixture(scope="module")
def seasonal(spark):
    trend = 100 + np.arange(60) * 2.0
    return months_frame(
        spark, {"season": trend * np.tile(FACTORS, 5), "short": np.ones(11), "zero": np.r_[np.zeros(1), np.ones(35)]}
    )


def test_decomposition_finds_factors_and_multiplies_back(seasonal):
    out = series.decompose(seasonal, ["s"]).filter("s = 'season'").orderBy("t").collect()
    assert len(out) == 60
    factors = np.array([r.seasonal for r in out[:12]])
    assert factors.mean() == pytest.approx(1)
    assert np.abs(factors - FACTORS / FACTORS.mean()).max() < 0.02
    for r in out[6:54]:
        assert r.trend * r.seasonal * r.resid == pytest.approx(r.y)
    assert out[0].trend is None and out[59].trend is None


def test_decomposition_reports_short_and_non_positive_series(seasonal):
    status = {r.s: r.status for r in series.decompose(seasonal, ["s"]).select("s", "status").distinct().collect()}
    assert status == {"season": "ok", "short": "too_short", "zero": "not_positive"}
    strength = {r.s: r for r in series.pattern_strength(series.decompose(seasonal, ["s"]), ["s"]).collect()}
    assert strength["season"].verdict == "strong" and strength["short"].verdict is None


@pytest.fixture(scope="module")
def ar_and_walk(spark):
    rng = np.random.default_rng(7)
    noise = rng.normal(size=160)
    ar = np.zeros(160)
    for i in range(1, 160):
        ar[i] = 0.6 * ar[i - 1] + noise[i]
    return months_frame(spark, {"ar": ar, "walk": np.cumsum(rng.normal(size=160))})


def test_unit_root_verdicts(ar_and_walk):
    out = forecast.stationarity(ar_and_walk, ["s"]).orderBy("s", "differences").collect()
    first = {r.s: r.stationary for r in out if r.differences == 0}
    assert first == {"ar": True, "walk": False}
    assert [r.stationary for r in out if r.s == "walk" and r.differences == 1] == [True]
    assert [r.differences for r in out if r.s == "ar"] == [0]


def test_unit_root_p_values():
    assert unitroot.p_value(-2.86) == pytest.approx(0.05, abs=0.002)
    assert unitroot.p_value(-3.43) == pytest.approx(0.01, abs=0.001)
    assert unitroot.dickey_fuller(np.ones(50)) is None


def test_partial_autocorrelation_cuts_off_after_one_lag(ar_and_walk):
    acf = series.autocorrelation(ar_and_walk, ["s"])
    out = forecast.partial_autocorrelation(acf, ["s"]).filter("s = 'ar'").orderBy("lag").collect()
    assert out[0].pacf == 1 and out[1].pacf == pytest.approx(0.6, abs=0.15)
    assert np.mean([abs(r.pacf) < 0.25 for r in out[2:]]) == 1
    lag1 = acf.filter("s = 'ar' AND lag = 1").first().acf
    assert out[1].pacf == pytest.approx(lag1)


def test_least_squares_recovers_parameters():
    rng = np.random.default_rng(3)
    e = rng.normal(size=2000)
    y = np.zeros(2000)
    for i in range(1, 2000):
        y[i] = 0.7 * y[i - 1] + e[i] + 0.4 * e[i - 1]
    theta, variance = arima.fit(y, (1, 0, 1, 0, 0, 0, 12))
    assert theta == pytest.approx([0.7, 0.4], abs=0.06) and variance == pytest.approx(1, abs=0.1)


def test_seasonal_walk_repeats_last_year():
    y = np.tile(np.arange(12.0), 4)
    means, spread = arima.forecast(y, (0, 0, 0, 0, 1, 0, 12), 12)
    assert means == pytest.approx(np.arange(12.0)) and spread == pytest.approx(np.zeros(12))


def test_walk_interval_grows_with_the_root_of_time():
    y = np.cumsum(np.random.default_rng(1).normal(size=300))
    means, spread = arima.forecast(y, (0, 1, 0, 0, 0, 0, 12), 4)
    assert means == pytest.approx(np.full(4, y[-1])) and spread == pytest.approx(spread[0] * np.sqrt([1, 2, 3, 4]))


def test_grid_has_ninety_candidates():
    assert len(forecast.arima_grid()) == 90


def test_grid_search_beats_the_spread_of_a_seasonal_series(spark, seasonal):
    grid = forecast.sarima_grid(seasonal, ["s"], train_share=0.8)
    best = {r.s: r for r in forecast.sarima_select(forecast.sarima_scores(grid, ["s"]), seasonal, ["s"]).collect()}
    assert best["season"].status == "ok" and best["season"].mape < 0.05
    assert best["short"].status == "too_short" and best["short"].order is None
    selected = forecast.sarima_select(forecast.sarima_scores(grid, ["s"]), seasonal, ["s"])
    future = forecast.sarima_future(seasonal, selected, ["s"], 12).filter("s = 'season'").orderBy("ds").collect()
    assert len(future) == 12 and future[0].ds == dt.date(2023, 1, 31)
    want = (100 + np.arange(60, 72) * 2.0) * FACTORS
    assert np.abs(np.array([r.forecast for r in future]) / want - 1).max() < 0.1
    assert all(r.lower_bound <= r.forecast <= r.upper_bound for r in future)


def test_additive_forecast_follows_trend_and_season(spark, seasonal):
    out = forecast.additive_forecast(seasonal.filter("s = 'season'"), ["s"], 12).orderBy("ds").collect()
    want = (100 + np.arange(60, 72) * 2.0) * FACTORS
    assert np.abs(np.array([r.forecast for r in out]) / want - 1).mean() < 0.1
    for r in out:
        assert r.forecast == pytest.approx(r.trend * (1 + r.yearly + r.monthly))
    days = forecast.additive_forecast(seasonal.filter("s = 'season'"), ["s"], 5, "D", components=False).orderBy("ds").collect()
    assert [r.ds for r in days] == [dt.date(2023, 1, n) for n in range(1, 6)]


def test_backtest_and_comparison(spark, seasonal):
    scores = stats.regression_metrics(forecast.additive_backtest(seasonal, ["s"]), "y", "forecast", ["s"])
    mape = {r.s: r.mape for r in scores.collect()}
    assert mape["season"] < 0.15 and mape["short"] is None
    other = scores.withColumn("mae", F.lit(0.0))
    best = {r.s: r.best_model for r in forecast.compare_models({"SARIMA": scores, "Additive": other}, ["s"]).collect()}
    assert best["season"] == "Additive"


def test_interval_widens_with_noise():
    days = np.arange(0, 2000, 30.0)
    rng = np.random.default_rng(0)
    calm = additive.AdditiveModel(days, 100 + rng.normal(0, 0.1, len(days))).predict(np.array([2010.0]))
    wild = additive.AdditiveModel(days, 100 + rng.normal(0, 20, len(days))).predict(np.array([2010.0]))
    assert (calm["upper_bound"] - calm["lower_bound"])[0] < (wild["upper_bound"] - wild["lower_bound"])[0]
