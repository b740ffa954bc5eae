"""Stored forecast models go on as a new fit would; rolling validation doesn't see the test months."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillspark.functions import arima
from tillspark.operators import forecast

from test_series_models import FACTORS, months_frame  # isort: skip


@pytest.fixture(scope="module")
def named(spark):
    r = np.random.default_rng(3)
    season = (100 + np.arange(72) * 2.0) * np.tile(FACTORS, 6) + r.normal(0, 1, 72)
    walk = 50 + np.cumsum(r.normal(size=72))
    return months_frame(spark, {"season": season, "walk": walk, "short": np.ones(11) + np.arange(11), "one": np.ones(1), "middle": r.normal(10, 1, 30)})


GRID = [(0, 1, 1, 0, 0, 0, 12), (1, 0, 0, 0, 1, 0, 12), (0, 1, 1, 0, 1, 1, 12), (2, 0, 1, 0, 0, 0, 12)]


@pytest.fixture(scope="module")
def selected(named):
    return forecast.sarima_select(forecast.sarima_scores(forecast.sarima_grid(named, ["s"], GRID), ["s"]), named, ["s"])


def table(df, *order):
    return df.orderBy(*order).toPandas()


def test_a_state_goes_on_as_the_fit():
    y = np.cumsum(np.random.default_rng(1).normal(size=90)) + 10 * np.sin(np.arange(90) / 12 * 2 * np.pi) + 50
    for order in forecast.arima_grid():
        state = arima.state(y, order)
        if state is None:
            continue
        plain = {k: np.asarray(v).tolist() for k, v in state.items()}
        for a, b in zip(arima.ahead(plain, order, 15), arima.forecast(y, order, 15)):
            assert np.array_equal(a, b)


def test_residuals_against_the_recursion():
    r = np.random.default_rng(2)
    w, ar, ma = r.normal(size=60), np.array([1, -0.4, 0.2]), np.r_[1, 0.5, np.zeros(10), 0.3, 0.15]
    target, errors = np.convolve(w, ar)[2:60], []
    for t, value in enumerate(target):
        errors.append(value - sum(ma[k] * errors[t - k] for k in range(1, len(ma)) if t >= k))
    assert np.abs(arima._residuals(w, ar, ma) - errors).max() < 1e-9


def test_stored_sarima_equals_a_new_fit(spark, named, selected, tmp_path):
    path = str(tmp_path / "sarima")
    forecast.save_models(forecast.sarima_models(named, selected, ["s"]), path, 3)
    back = forecast.load_models(spark, path)
    assert {r.s: r.status for r in back.collect()} == {"season": "ok", "walk": "ok", "middle": "ok", "short": "too_short", "one": "too_short"}
    a, b = table(forecast.sarima_ahead(back, ["s"], 9), "s", "ds"), table(forecast.sarima_future(named, selected, ["s"], 9), "s", "ds")
    assert list(a.s) == list(b.s) and list(a.ds) == list(b.ds) and list(a.status) == list(b.status)
    for c in ("forecast", "lower_bound", "upper_bound"):
        assert np.nanmax(np.abs(a[c] - b[c])) < 1e-9
    fitted = forecast._forecast_rows  # the stored table is all that is read
    forecast._forecast_rows = None
    try:
        assert forecast.sarima_ahead(back, ["s"], 2).filter("s = 'walk'").count() == 2
    finally:
        forecast._forecast_rows = fitted


def test_stored_additive_equals_a_new_fit(spark, named, tmp_path):
    path = str(tmp_path / "additive")
    forecast.save_models(forecast.additive_models(named, ["s"]), path, 1)
    for freq, c in (("M", True), ("D", False)):
        a = table(forecast.additive_ahead(forecast.load_models(spark, path), ["s"], 6, freq), "s", "ds")
        b = table(forecast.additive_forecast(named, ["s"], 6, freq), "s", "ds")
        assert list(a.s) == list(b.s) and list(a.status) == list(b.status)
        for column in ("forecast", "lower_bound", "upper_bound", "trend", "yearly", "monthly") if c else ("forecast",):
            assert np.nanmax(np.abs(a[column] - b[column])) < 1e-9


def test_versions_and_horizons(spark, named, selected, tmp_path):
    path = str(tmp_path / "versions")
    models = forecast.sarima_models(named, selected, ["s"])
    forecast.save_models(models, path, 1)
    forecast.save_models(models.filter("s = 'walk'"), path, 2)
    assert forecast.load_models(spark, path).count() == 1 and forecast.load_models(spark, path, 1).count() == 5
    assert {r.version for r in forecast.load_models(spark, path, 1).collect()} == {1}
    forecast.save_models(models.filter("s = 'season'"), path, 2)  # written again: replaced
    assert [r.s for r in forecast.load_models(spark, path).collect()] == ["season"]
    steps = spark.createDataFrame([("season", 3), ("walk", 5), ("middle", 0)], "s string, steps int")
    out = forecast.sarima_ahead(forecast.load_models(spark, path, 1), ["s"], steps)
    assert {r.s: r.n for r in out.groupBy("s").agg(F.count("forecast").alias("n")).collect()} == {"season": 3, "walk": 5}


def test_choice_is_blind_to_the_test_months(spark, named):
    first = {r.s: r for r in forecast.sarima_validated(named, ["s"], GRID).collect()}
    assert {k: r.status for k, r in first.items()} == {"season": "ok", "walk": "ok", "short": "too_short", "one": "too_short", "middle": "too_short"}
    cut = F.floor(F.count("y").over(Window.partitionBy("s")) * 0.8)
    place = F.row_number().over(Window.partitionBy("s").orderBy("t"))
    altered = named.select("s", "ds", "t", F.when(place > cut, F.col("y") * 3 + 1000).otherwise(F.col("y")).alias("y"))
    second = {r.s: r for r in forecast.sarima_validated(altered, ["s"], GRID).collect()}
    for s in ("season", "walk"):
        assert first[s].order == second[s].order and first[s].validation_mae == second[s].validation_mae
        assert second[s].mae > 100 > first[s].mae


def test_validation_errors_by_hand(spark, named):
    got = {r.s: r for r in forecast.sarima_validated(named, ["s"], GRID, origins=2, window=4).collect()}["walk"]
    y = np.array([r.y for r in named.filter("s = 'walk'").orderBy("t").collect()])
    train, test = y[:57], y[57:]

    def error(order):
        return np.mean([np.abs(arima.forecast(train[:c], order, 4)[0] - train[c : c + 4]).mean() for c in (49, 53)])

    best = min(GRID, key=lambda o: (error(o), o))
    assert tuple(got.order) == best and got.validation_mae == pytest.approx(error(best))
    assert got.mae == pytest.approx(np.abs(arima.forecast(train, best, len(test))[0] - test).mean())


def test_one_series_without_keys(spark, named):
    one = named.filter("s = 'season'").drop("s")
    out = forecast.sarima_validated(one, (), GRID).collect()
    assert len(out) == 1 and out[0].status == "ok" and out[0].mae is not None
    none = forecast.sarima_validated(named.filter("s = 'short'").drop("s"), (), GRID).collect()
    assert [(r.status, r.order, r.mae) for r in none] == [("too_short", None, None)]
