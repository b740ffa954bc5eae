"""Forecasts of daily and monthly series."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillspark.functions import arima, unitroot
from tillspark.functions import exprs as X
from tillspark.functions.additive import AdditiveModel
from tillspark.operators.stats import regression_metrics
from tillspark.session import materialise

Keys = Sequence[str]

MAX_NAIVE_DAYS = 30  # fixed value: longest horizon of the moving-average forecast


def naive_forecast(
    daily: DataFrame,
    days_ahead: int,
    keys: Keys = (),
    start_offset: int = 0,
    capped: bool = False,
    weights: tuple[float, float] = (0.7, 0.3),
) -> DataFrame:
    """Flat forecast from the means of the last 7 and the last 30 observed days.

    The first forecast day is the last observed one plus ``start_offset``; with ``capped`` at most 30 days are given.
    """
    days = min(days_ahead, MAX_NAIVE_DAYS) if capped else days_ahead
    if days < 1:
        return naive_forecast(daily, 1, keys, start_offset, capped, weights).limit(0)
    newest = Window.partitionBy(*keys).orderBy(F.desc("sale_date"))
    recent = daily.withColumn("_age", F.row_number().over(newest)).filter(F.col("_age") <= 30)
    week = F.when(F.col("_age") <= 7, F.col("daily_total"))
    means = recent.groupBy(*keys).agg(
        F.max("sale_date").alias("_last"),
        X.mean(week).alias("forecast_7day_avg"),
        X.mean("daily_total").alias("forecast_30day_avg"),
    )
    steps = F.sequence(F.lit(start_offset), F.lit(start_offset + days - 1))
    blend = F.col("forecast_7day_avg") * weights[0] + F.col("forecast_30day_avg") * weights[1]
    return means.select("*", F.explode(steps).alias("_step")).select(
        *keys,
        F.date_add("_last", F.col("_step")).alias("forecast_date"),
        "forecast_7day_avg",
        "forecast_30day_avg",
        blend.alias("weighted_forecast"),
    )


# ---- models of monthly series ------------------------------------------------------------------------------------------
#
# A monthly series travels as one row holding its values in order: at most one value per calendar month. Spark spreads the
# (series, candidate) rows over the cluster; numpy fits one of them at a time, and choosing and comparing is aggregation.


def _with_short(points: DataFrame, short: DataFrame, keys: Keys, status: Column) -> DataFrame:
    """``points`` marked ``ok``, and a row without figures for each series that has none, with its ``status``."""
    none = short.select(*keys, status.alias("status"))
    return points.withColumn("status", F.lit("ok")).unionByName(none, allowMissingColumns=True)


def series_rows(months: DataFrame, keys: Keys = ()) -> DataFrame:
    """One row per series: ``y`` and ``days`` (days since 1970) in time order."""
    points = F.sort_array(F.collect_list(F.struct("t", F.unix_date("ds").cast("double").alias("day"), "y")))
    return months.groupBy(*keys).agg(points.alias("_p")).select(
        *keys, F.col("_p.y").alias("y"), F.col("_p.day").alias("days"), F.size("_p").alias("n")
    )


def _hold_out(rows: DataFrame, train_share: float) -> DataFrame:
    """Split each series at ``floor(share * n)``."""
    cut = F.greatest(F.floor(F.col("n") * train_share).cast("int"), F.lit(1))
    return rows.withColumn("_cut", cut).withColumns(
        {
            "train": F.slice("y", 1, F.col("_cut")),
            "train_days": F.slice("days", 1, F.col("_cut")),
            "actual": F.slice("y", F.col("_cut") + 1, F.col("n")),
            "actual_days": F.slice("days", F.col("_cut") + 1, F.col("n")),
        }
    )


def _spread(rows: DataFrame, *by: str) -> DataFrame:
    """Give every task its share of fits. The count is fixed because AQE would merge rows this small into one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def arima_grid(
    p: Sequence[int] = (0, 1, 2),
    d: Sequence[int] = (0, 1),
    q: Sequence[int] = (0, 1, 2),
    sp: Sequence[int] = (0, 1),
    sd: Sequence[int] = (0, 1),
    sq: Sequence[int] = (0, 1),
    season: int = 12,
    limit: int = 4,
) -> list[tuple[int, ...]]:
    """Orders ``(p, d, q, P, D, Q, s)`` whose sum without the season is at most ``limit``."""
    return [(*o, season) for o in product(p, d, q, sp, sd, sq) if sum(o) <= limit]


def _fit_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Forecast every row's ``train`` with its ``order`` for ``steps`` periods; a failed fit gives no forecast."""
    for batch in batches:
        out = [arima.forecast(np.array(r.train), tuple(int(v) for v in r.order), int(r.steps)) for r in batch.itertuples()]
        yield batch.drop(columns=["train"]).assign(
            forecast=[None if o is None else list(o[0]) for o in out],
            spread=[None if o is None else list(o[1]) for o in out],
        )


def _forecast_rows(rows: DataFrame) -> DataFrame:
    schema = rows.drop("train").schema
    for name in ("forecast", "spread"):
        schema = schema.add(name, T.ArrayType(T.DoubleType()))
    return rows.mapInPandas(_fit_rows, schema)


MIN_MONTHS = 24  # fixed value: shortest series for a seasonal model or a backtest
NORMAL_95 = 1.959963984540054


def sarima_grid(
    months: DataFrame, keys: Keys = (), grid: Sequence[tuple[int, ...]] | None = None, train_share: float = 0.8
) -> DataFrame:
    """Every candidate's forecast of the held-out months: ``keys, order, ds, y, forecast, lower_bound, upper_bound``.

    One row per series and candidate is fitted; series shorter than 24 months are left out (see ``sarima_select``).
    """
    orders = F.array(*(F.array(*(F.lit(v) for v in o)) for o in (grid or arima_grid())))
    held = _hold_out(series_rows(months, keys).filter(F.col("n") >= MIN_MONTHS), train_share)
    candidates = held.select(
        *keys, "train", "actual", "actual_days", F.size("actual").alias("steps"), F.explode(orders).alias("order")
    )
    fitted = _forecast_rows(_spread(candidates, *keys, "order"))
    points = fitted.filter(F.col("forecast").isNotNull()).select(
        *keys,
        "order",
        F.inline(F.arrays_zip("actual_days", F.col("actual").alias("y"), "forecast", "spread")),
    )
    return points.select(
        *keys,
        "order",
        F.date_from_unix_date(F.col("actual_days").cast("int")).alias("ds"),
        "y",
        "forecast",
        (F.col("forecast") - NORMAL_95 * F.col("spread")).alias("lower_bound"),
        (F.col("forecast") + NORMAL_95 * F.col("spread")).alias("upper_bound"),
    )


def sarima_scores(grid: DataFrame, keys: Keys = ()) -> DataFrame:
    """Errors of every candidate on the held-out months."""
    return regression_metrics(grid, "y", "forecast", [*keys, "order"])


def sarima_select(scores: DataFrame, months: DataFrame, keys: Keys = ()) -> DataFrame:
    """Candidate with the smallest MAE per series, ties by order; short series come back as ``too_short``.

    The months that score a candidate also choose it, so the reported error is optimistic; ``sarima_validated`` keeps them apart.
    """
    pick = F.min_by(F.struct("order", "mae", "rmse", "mape"), F.struct("mae", "order"))
    best = scores.groupBy(*keys).agg(pick.alias("_b"))
    sizes = months.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    joined = sizes.join(best, list(keys), "left") if keys else sizes.withColumn("_b", best.scalar())
    joined = joined.select(*keys, "n", "_b.*")
    status = F.when(F.col("n") < MIN_MONTHS, "too_short").when(F.col("order").isNull(), "no_fit").otherwise("ok")
    return joined.withColumn("status", status)


def sarima_validated(
    months: DataFrame,
    keys: Keys = (),
    grid: Sequence[tuple[int, ...]] | None = None,
    train_share: float = 0.8,
    origins: int = 3,
    window: int = 6,
) -> DataFrame:
    """Best candidate by rolling origins, and its errors on months that took no part in the choice.

    The last ``1 - train_share`` of a series are its test months. Of the months before, the last ``origins * window`` are
    forecast in windows, each from all months before it; the candidate with the smallest mean absolute error over all windows
    (ties by order), among those that could be fitted for each, is fitted on all months before the test. Both errors are
    given: ``validation_mae``, and ``mae``, ``rmse``, ``mape`` of the test. A series with fewer than 24 months before its
    first window is ``too_short``. Fits are rows of (series, candidate, origin).
    """
    orders = F.array(*(F.array(*(F.lit(v) for v in o)) for o in (grid or arima_grid())))
    held = materialise(_hold_out(series_rows(months, keys), train_share))
    first = F.size("train") - origins * window
    enough = held.filter((first >= MIN_MONTHS) & (F.size("actual") > 0))
    cut = first + F.col("_origin") * window
    windows = enough.select("*", F.explode(F.sequence(F.lit(0), F.lit(origins - 1))).alias("_origin")).select(
        *keys, F.slice("train", F.lit(1), cut).alias("train"), F.slice("train", cut + 1, F.lit(window)).alias("actual"),
        F.lit(window).alias("steps"), "_origin", F.explode(orders).alias("order"),
    )
    gap = F.aggregate(F.zip_with("actual", "forecast", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda x, y: x + y) / window
    tried = _forecast_rows(_spread(windows, *keys, "order", "_origin")).filter(F.col("forecast").isNotNull())
    scores = tried.groupBy(*keys, "order").agg(F.avg(gap).alias("validation_mae"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == origins)
    best = scores.groupBy(*keys).agg(F.min_by(F.struct("order", "validation_mae"), F.struct("validation_mae", "order")).alias("_b"))
    chosen = materialise(best.select(*keys, "_b.*"))
    ready = enough.select(*keys, "train", "actual", F.size("actual").alias("steps"))
    paired = ready.join(chosen, list(keys)) if keys else ready.crossJoin(chosen.limit(1))
    tested = _forecast_rows(_spread(paired, *keys) if keys else paired).filter(F.col("forecast").isNotNull())
    points = tested.select(*keys, F.inline(F.arrays_zip(F.col("actual").alias("y"), "forecast")))
    errors = regression_metrics(points, "y", "forecast", keys).select(*keys, "mae", "rmse", "mape")
    sizes = held.select(*keys, F.col("n").cast("bigint").alias("n"), ((first >= MIN_MONTHS) & (F.size("actual") > 0)).alias("_enough"))
    if keys:
        out = sizes.join(chosen, list(keys), "left").join(errors, list(keys), "left")
    else:
        nothing = sizes.sparkSession.range(1).select()
        out = sizes.crossJoin(nothing.join(chosen, how="left")).crossJoin(nothing.join(errors, how="left"))
    status = F.when(~F.col("_enough"), "too_short").when(F.col("order").isNull(), "no_fit").otherwise("ok")
    return out.select(*keys, "n", "order", "validation_mae", "mae", "rmse", "mape", status.alias("status"))


# ---- stored models -----------------------------------------------------------------------------------------------------
#
# A fitted model is one row a series: what it needs to go on from its last month. Forecasting joins horizons to these rows and
# fits nothing. Versions of the table are folders; readers take the newest one or the one they name.

_ARIMA_STATE = "struct<theta array<double>, variance double, values array<double>, errors array<double>>"
_ADDITIVE_STATE = "struct<start double, span double, scale double, noise double, changes array<double>, theta array<double>, beta array<double>>"


def _mapped(rows: DataFrame, used: Sequence[str], made: dict[str, str], run) -> DataFrame:
    """Replace the columns ``used`` by the columns ``made``, whose values ``run`` gives for each row."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [run(*values) for values in zip(*(batch[c] for c in used))]
            yield batch.drop(columns=list(used)).assign(**{c: [None if f is None else f[i] for f in found] for i, c in enumerate(made)})

    schema = rows.drop(*used).withColumns({c: F.lit(None).cast(kind) for c, kind in made.items()}).schema
    return rows.mapInPandas(work, schema)


def _plain(state: dict | None) -> dict | None:
    return None if state is None else {k: list(map(float, v)) if np.ndim(v) else float(v) for k, v in state.items()}


def sarima_models(months: DataFrame, selected: DataFrame, keys: Keys = ()) -> DataFrame:
    """The chosen order of each series fitted on all its months: ``keys, order, last, n, status, state``.

    A series that was too short or has no fit keeps its ``status`` and has no state.
    """
    every = series_rows(months, keys).select(*keys, "y", F.date_from_unix_date(F.element_at("days", -1).cast("int")).alias("last"), "n")
    picked = selected.select(*keys, "order", "status")
    paired = every.join(picked, list(keys)) if keys else every.crossJoin(picked.limit(1))

    def run(y, order, status):
        found = arima.state(np.array(y, dtype=float), tuple(int(v) for v in order)) if status == "ok" else None
        return (_plain(found), "no_fit" if status == "ok" and found is None else status)

    todo = paired.withColumns({"_y": F.col("y"), "_order": F.col("order"), "_status": F.col("status")}).drop("y", "status")
    return _mapped(_spread(todo, *keys) if keys else todo, ("_y", "_order", "_status"), {"state": _ARIMA_STATE, "status": "string"}, run)


def _with_horizon(models: DataFrame, horizon: int | DataFrame, keys: Keys) -> DataFrame:
    if not isinstance(horizon, DataFrame):
        return models.withColumn("steps", F.lit(horizon))
    wanted = horizon.select(*keys, F.col("steps").cast("int").alias("steps"))
    return models.join(wanted, list(keys)) if keys else models.crossJoin(wanted.limit(1))


def sarima_ahead(models: DataFrame, keys: Keys = (), horizon: int | DataFrame = 12) -> DataFrame:
    """Months after each series' last one from stored models; ``horizon`` is one number or a table (keys, steps).

    A series without state is one row with its ``status`` and no figures.
    """
    asked = _with_horizon(models, horizon, keys)
    able = asked.filter((F.col("status") == "ok") & (F.col("steps") > 0)).select(*keys, "order", "last", "state", F.col("order").alias("_order"), "steps")

    def run(state, order, steps):
        found = arima.ahead(state, tuple(int(v) for v in order), int(steps))
        return None if found is None else (list(found[0]), list(found[1]))

    made = _mapped(able, ("state", "_order", "steps"), {"forecast": "array<double>", "spread": "array<double>"}, run)
    done = materialise(made)
    points = done.filter(F.col("forecast").isNotNull()).select(*keys, "order", "last", F.posexplode(F.arrays_zip("forecast", "spread")).alias("_h", "_v"))
    mean, spread = F.col("_v.forecast"), F.col("_v.spread")
    ahead = points.select(
        *keys,
        "order",
        F.last_day(F.add_months("last", F.col("_h") + 1)).alias("ds"),
        mean.alias("forecast"),
        (mean - NORMAL_95 * spread).alias("lower_bound"),
        (mean + NORMAL_95 * spread).alias("upper_bound"),
    )
    out = _with_short(ahead, asked.filter(F.col("status") != "ok"), keys, F.col("status"))
    failed = done.filter(F.col("forecast").isNull())
    return out.unionByName(failed.select(*keys, F.lit("no_fit").alias("status")), allowMissingColumns=True)


def sarima_future(months: DataFrame, selected: DataFrame, keys: Keys = (), horizon: int = 12) -> DataFrame:
    """Forecast after the last month, from the chosen order fitted on the whole series.

    A series that was too short or had no fit is one row with that ``status`` and no figures.
    """
    return sarima_ahead(materialise(sarima_models(months, selected, keys)), keys, horizon)


def additive_models(months: DataFrame, keys: Keys = (), change_scale: float = 0.05) -> DataFrame:
    """The additive model of each series: ``keys, last, n, status, state``; a series of one month is ``too_short``."""
    every = series_rows(months, keys).select(*keys, "y", "days", F.date_from_unix_date(F.element_at("days", -1).cast("int")).alias("last"), "n")

    def run(y, days):
        if len(y) < 2:
            return None, "too_short"
        return _plain(AdditiveModel(np.array(days, dtype=float), np.array(y, dtype=float), change_scale).state()), "ok"

    return _mapped(_spread(every, *keys) if keys else every, ("y", "days"), {"state": _ADDITIVE_STATE, "status": "string"}, run)


def additive_ahead(models: DataFrame, keys: Keys = (), horizon: int | DataFrame = 24, freq: str = "M", level: float = 0.95) -> DataFrame:
    """Months (``M``) or days (``D``) after each series' last day from stored models, with components."""
    if freq not in ("M", "D"):
        raise ValueError("freq must be 'M' or 'D'")
    asked = _with_horizon(models, horizon, keys)
    step = (lambda h: F.last_day(F.add_months("last", h))) if freq == "M" else (lambda h: F.date_add("last", h))
    able = asked.filter((F.col("status") == "ok") & (F.col("steps") > 0))
    target = F.transform(F.sequence(F.lit(1), F.col("steps")), lambda h: F.unix_date(step(h)).cast("double"))
    todo = able.select(*keys, "state", target.alias("target_days"), target.alias("_days"))

    def run(state, days):
        found = AdditiveModel.restored(state).predict(np.array(days, dtype=float), level)
        return tuple(list(found[p]) for p in _PARTS)

    points = _mapped(todo, ("state", "_days"), {p: "array<double>" for p in _PARTS}, run)
    shown = points.select(*keys, F.inline(F.arrays_zip("target_days", *_PARTS)))
    ahead = shown.select(*keys, F.date_from_unix_date(F.col("target_days").cast("int")).alias("ds"), *_PARTS)
    return _with_short(ahead, asked.filter(F.col("status") != "ok"), keys, F.col("status"))


def save_models(models: DataFrame, path: str, version: int) -> None:
    """Write a table of models as a version of its own under ``path``; a version written again is replaced as a whole."""
    models.write.mode("overwrite").parquet(f"{path}/version={int(version)}")


def load_models(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The named version of a table of models, else the newest; ``version`` is a column. Only its folder is read."""
    table = spark.read.option("basePath", path).parquet(path if version is None else f"{path}/version={int(version)}")
    return table.filter(F.col("version") == table.agg(F.max("version")).scalar()) if version is None else table


# ---- trend and seasonality ---------------------------------------------------------------------------------------------

_PARTS = ("forecast", "lower_bound", "upper_bound", "trend", "yearly", "monthly")


def _predict_rows(rows: DataFrame, level: float, change_scale: float) -> DataFrame:
    """Fit ``train`` at ``train_days`` and predict at ``target_days``, row by row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                AdditiveModel(np.array(r.train_days), np.array(r.train), change_scale).predict(np.array(r.target_days), level)
                for r in batch.itertuples()
            ]
            kept = batch.drop(columns=["train", "train_days"])
            yield kept.assign(**{p: [list(o[p]) for o in out] for p in _PARTS})

    schema = rows.drop("train", "train_days").withColumns({p: F.array(F.lit(0.0)) for p in _PARTS}).schema
    return rows.mapInPandas(run, schema)


def additive_forecast(
    months: DataFrame,
    keys: Keys = (),
    horizon: int = 24,
    freq: str = "M",
    history: bool = False,
    components: bool = True,
    level: float = 0.95,
    change_scale: float = 0.05,
) -> DataFrame:
    """Forecast of trend times yearly and monthly seasonality, ``horizon`` months (``M``) or days (``D``) ahead.

    A series of one month is one row with ``status`` ``too_short`` and no figures.
    """
    every = series_rows(months, keys)
    rows = every.filter(F.col("n") >= 2)
    last = F.date_from_unix_date(F.element_at("days", -1).cast("int"))
    steps = F.sequence(F.lit(1), F.lit(horizon))
    if freq == "M":
        ahead = F.transform(steps, lambda h: F.unix_date(F.last_day(F.add_months(last, h))).cast("double"))
    elif freq == "D":
        ahead = F.transform(steps, lambda h: F.element_at("days", -1) + h)
    else:
        raise ValueError("freq must be 'M' or 'D'")
    target = F.concat("days", ahead) if history else ahead
    todo = rows.select(*keys, F.col("y").alias("train"), F.col("days").alias("train_days"), target.alias("target_days"))
    points = _predict_rows(_spread(todo, *keys) if keys else todo, level, change_scale).select(
        *keys, F.inline(F.arrays_zip("target_days", *_PARTS))
    )
    wanted = _PARTS if components else _PARTS[:3]
    ahead = points.select(*keys, F.date_from_unix_date(F.col("target_days").cast("int")).alias("ds"), *wanted)
    return _with_short(ahead, every.filter(F.col("n") < 2), keys, F.lit("too_short"))


def additive_backtest(months: DataFrame, keys: Keys = (), train_share: float = 0.8, change_scale: float = 0.05) -> DataFrame:
    """Held-out months against a model of the same configuration fitted on the months before them.

    A series of fewer than 24 months is one row with ``status`` ``too_short`` and no figures.
    """
    every = series_rows(months, keys)
    held = _hold_out(every.filter(F.col("n") >= MIN_MONTHS), train_share)
    todo = held.select(*keys, "train", "train_days", "actual", F.col("actual_days").alias("target_days"))
    points = _predict_rows(_spread(todo, *keys) if keys else todo, 0.95, change_scale)
    tested = points.select(*keys, F.inline(F.arrays_zip("target_days", F.col("actual").alias("y"), *_PARTS[:3]))).select(
        *keys, F.date_from_unix_date(F.col("target_days").cast("int")).alias("ds"), "y", *_PARTS[:3]
    )
    return _with_short(tested, every.filter(F.col("n") < MIN_MONTHS), keys, F.lit("too_short"))


def compare_models(scores: dict[str, DataFrame], keys: Keys = ()) -> DataFrame:
    """MAE per model side by side, and the better one of each series; null where no model has errors."""
    parts = [df.select(*keys, F.lit(name).alias("model"), "mae") for name, df in scores.items()]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    columns = [F.max(F.when(F.col("model") == n, F.col("mae"))).alias(f"{n.lower()}_mae") for n in scores]
    return table.groupBy(*keys).agg(*columns, F.min_by("model", F.when(F.col("mae").isNotNull(), F.struct("mae", "model"))).alias("best_model"))


# ---- stationarity --------------------------------------------------------------------------------------------------------

_ADF = "differences int, n int, status string, statistic double, p_value double, lags int, critical_1 double, critical_5 double, critical_10 double, stationary boolean"


def stationarity(months: DataFrame, keys: Keys = (), level: float = 0.05) -> DataFrame:
    """Augmented Dickey-Fuller test of the series; while it is not stationary, also of its first and second difference."""
    rows = series_rows(months, keys)
    kept = list(keys)

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                values = np.array(r["y"], dtype=float)
                for times in range(3):
                    found = unitroot.dickey_fuller(values)
                    head = [r[k] for k in kept] + [times, len(values)]
                    if found is None:
                        out.append([*head, "too_short", None, None, None, None, None, None, None])
                        break
                    stationary = found["p_value"] <= level
                    out.append([*head, "ok", found["statistic"], found["p_value"], found["lags"], *found["critical"].values(), stationary])
                    if stationary or len(r["y"]) <= 12:
                        break
                    values = np.diff(values)
            columns = [*kept, *(c.split()[0] for c in _ADF.split(", "))]
            yield pd.DataFrame(out, columns=columns).astype({"lags": "Int64", "stationary": "boolean"})

    fields = [f"`{k}` {dict(rows.dtypes)[k]}" for k in kept]
    return (_spread(rows, *keys) if keys else rows).mapInPandas(test, ", ".join([*fields, _ADF]))


def partial_autocorrelation(acf: DataFrame, keys: Keys = ()) -> DataFrame:
    """Partial autocorrelations from the output of ``series.autocorrelation`` (at most 25 lags per series)."""
    lags = acf.groupBy(*keys).agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("lag", "acf"))).alias("_l")
    )
    rows = lags.select(*keys, "n", F.col("_l.acf").alias("acf"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(acf=[list(unitroot.partial_autocorrelations(np.array(a))) for a in batch["acf"]])

    out = rows.mapInPandas(run, rows.schema).select(*keys, "n", F.posexplode("acf").alias("lag", "pacf"))
    width = F.when(F.col("lag") > 0, NORMAL_95 / F.sqrt("n")).otherwise(0.0)
    return out.withColumn("half_width", width)
