"""Regression models, clusters and the isolation forest. Their numbers have no SQL form; tests check them instead."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tillspark.functions import exprs as X
from tillspark.operators import anomaly, attribution, cluster, isolation, kpi, model, segment, series, stats
from tillspark.plans.kpi_queries import daily
from tillspark.plans.registry import query, rounded
from tillspark.schemas import NUMERIC_COLUMNS
from tillspark.session import scratch_path
from tillspark.sources import star
from tillspark.sources.star import sales

# Rounds and trees of the registered models.
ROUNDS, TREES = 200, 200

_FITTED: dict[tuple, object] = {}


def once(spark, d, name, make):
    """Fitted models are kept for the session, as several reports read the same ones, until the tables are written again."""
    key = (spark.sparkContext.applicationId, star.version(spark, d), name)
    if key not in _FITTED:
        _FITTED[key] = make()
    return _FITTED[key]


ML_COLUMNS = ("transaction_id", "product_id", "date_of_sale", *NUMERIC_COLUMNS, *model.CATEGORICAL)


def fitted(spark, d) -> model.Fitted:
    return once(spark, d, "models", lambda: model.fit(sales(spark, d, *ML_COLUMNS), model.regressors(ROUNDS, TREES)))


@query("ml_prep")
def ml_prep(spark, d):
    """How the feature vector comes out: rows, width and mean of the scaled numbers on the test rows."""
    from pyspark.ml.functions import vector_to_array

    ready = fitted(spark, d).test.select(vector_to_array("features").alias("x"))
    return ready.agg(
        X.rows().alias("rows"), F.max(F.size("x")).alias("width"), F.round(F.avg(F.col("x")[0]), 3).alias("mean_quantity"),
        F.round(F.avg(F.aggregate(F.slice("x", F.lit(len(model.NUMERIC) + 1), F.size("x")), F.lit(0.0), lambda a, v: a + v)), 3).alias("mean_levels"),
    )


@query("ml_xgb")
def ml_xgb(spark, d):
    return fitted(spark, d).metrics("Second-Order Boosting")


@query("ml_rf")
def ml_rf(spark, d):
    return fitted(spark, d).metrics("Random Forest")


@query("ml_gbt")
def ml_gbt(spark, d):
    return fitted(spark, d).metrics("Gradient Boosting")


@query("ml_compare")
def ml_compare(spark, d):
    table = fitted(spark, d).compare()
    best = table.agg(F.max_by("model", "r2")).scalar()
    return table.withColumn("is_best", F.col("model") == best)


@query("argmax")
def argmax(spark, d):
    return fitted(spark, d).compare().agg(F.max_by("model", F.struct("r2", "model")).alias("best_model"), F.max("r2").alias("r2"))


@query("ml_importance")
def ml_importance(spark, d):
    return model.importance(fitted(spark, d), top_n=15)


@query("ml_attribution")
def ml_attribution(spark, d):
    """Mean absolute contribution of every feature over the whole test part, for the best model."""
    f = fitted(spark, d)
    return attribution.mean_contributions(f.test, f.model(f.best()), f.feature_names())


@query("ml_attribution_dependence")
def ml_attribution_dependence(spark, d):
    f = fitted(spark, d)
    top = [r.feature for r in model.importance(f, f.best(), 3).collect()]
    points = attribution.dependence(attribution.attributions(f.test, f.model(f.best())), f.feature_names(), top)
    return points.groupBy("feature", F.round("value", 1).alias("value")).agg(
        X.rows().alias("rows"), F.avg("contribution").alias("mean_contribution")
    )


@query("ml_predict")
def ml_predict(spark, d):
    """Every sales line with its prediction by the best model, beside the figures of its category."""
    f = fitted(spark, d)
    lines = model.clean.calendar_features(sales(spark, d, *ML_COLUMNS))
    path = scratch_path(spark, "predictions")
    model.predict(f.pipeline(), lines, f.preparation, f.best()).write.parquet(path)  # once, as lines and figures read it
    scored = spark.read.parquet(path)
    figures = kpi.group(
        scored, ["category", "model_used"], lines=X.rows(), total_sales=X.total("total_amount"), category_predicted_sales=F.sum("predicted_sales")
    )
    named = figures.withColumnRenamed("category", "_category").drop("model_used")
    return scored.join(named, F.col("category").eqNullSafe(F.col("_category"))).drop("_category")


@query("snk_model")
def snk_model(spark, d):
    """The best pipeline saved, loaded again and scored on all lines."""
    f = fitted(spark, d)
    path = scratch_path(spark, "sales-model")
    f.pipeline().write().overwrite().save(path)
    lines = model.clean.calendar_features(sales(spark, d, *ML_COLUMNS))
    scored = model.predict(PipelineModel.load(path), lines, f.preparation, f.best())
    return stats.regression_metrics(scored, "total_amount", "predicted_sales")


# ---- customers -------------------------------------------------------------------------------------------------------


def customer_points(spark, d):
    features = segment.customer_features(sales(spark, d, "customer_name", *NUMERIC_COLUMNS))
    return once(spark, d, "points", lambda: cluster.scaled(features))


def elbow_table(spark, d):
    return once(spark, d, "elbow", lambda: cluster.elbow(customer_points(spark, d)))


def chosen_k(spark, d) -> int:
    return cluster.pick_k([r.inertia for r in elbow_table(spark, d).orderBy("k").collect()])


def clustered(spark, d):
    return once(spark, d, "clusters", lambda: cluster.assign(customer_points(spark, d), chosen_k(spark, d)))


@query("ml_elbow")
def ml_elbow(spark, d):
    return elbow_table(spark, d)


@query("ml_elbow_pick")
def ml_elbow_pick(spark, d):
    return elbow_table(spark, d).filter(F.col("k") == chosen_k(spark, d))


@query("ml_kmeans")
def ml_kmeans(spark, d):
    return clustered(spark, d).select("customer_name", "cluster")


@query("ml_pca")
def ml_pca(spark, d):
    return cluster.project(clustered(spark, d)).select("customer_name", "cluster", "pc1", "pc2")


@query("agg_cluster_profile")
def agg_cluster_profile(spark, d):
    return cluster.profile(clustered(spark, d))


@query("ml_segment_label")
def ml_segment_label(spark, d):
    return cluster.profile(clustered(spark, d)).select("cluster", "segment_label")


# ---- isolation forest ------------------------------------------------------------------------------------------------


@query("anom_iforest")
def anom_iforest(spark, d):
    flagged = isolation.isolation_anomalies(daily(spark, d), min_rows=30)
    return rounded(flagged, "score", digits=6)


@query("anom_records")
def anom_records(spark, d):
    """One request a category, its days as JSON records, with sensitivities of its own; all answered in one job."""
    lines = sales(spark, d, "category", "date_of_sale", "total_amount")
    days = series.daily_totals(lines, ("category",))
    record = F.struct(F.col("sale_date").cast("string").alias("date"), X.double("daily_total").alias("sales"))
    asked = days.groupBy(F.col("category").alias("request_id")).agg(F.to_json(F.sort_array(F.collect_list(record))).alias("records"))
    share = F.lit(0.02) + F.pmod(F.crc32("request_id"), F.lit(4)) * 0.02
    return rounded(isolation.detect(asked.withColumn("sensitivity", share)), "score", digits=6)


@query("flt_mask")
def flt_mask(spark, d):
    """The highest and lowest flagged days."""
    return isolation.extremes(isolation.isolation_anomalies(daily(spark, d), min_rows=30)).select("side", "sale_date", "daily_total")


@query(
    "flt_mask_zscore",
    """WITH s AS (SELECT avg(CAST(daily_total AS DOUBLE)) AS m, stddev_pop(CAST(daily_total AS DOUBLE)) AS sd FROM daily),
    f AS (SELECT sale_date, daily_total FROM daily, s WHERE abs((CAST(daily_total AS DOUBLE) - m) / sd) > 1.5),
    h AS (SELECT *, row_number() OVER (ORDER BY daily_total DESC, sale_date) AS top, row_number() OVER (ORDER BY daily_total, sale_date) AS low FROM f)
    SELECT 'highest' AS side, sale_date, CAST(daily_total AS DOUBLE) AS daily_total FROM h WHERE top <= 5
    UNION ALL SELECT 'lowest', sale_date, CAST(daily_total AS DOUBLE) FROM h WHERE low <= 5""",
)
def flt_mask_zscore(spark, d):
    """The highest and lowest days of those that a z-score flags."""
    flagged = anomaly.zscores(daily(spark, d)).withColumn("anomaly", F.when(F.abs("z_score") > 1.5, 1).otherwise(0))
    return isolation.extremes(flagged).select("side", "sale_date", X.double("daily_total").alias("daily_total"))


@query(
    "metric_regression",
    """WITH p AS (SELECT sale_date, CAST(daily_total AS DOUBLE) AS y,
      CAST(lag(daily_total) OVER (ORDER BY sale_date) AS DOUBLE) AS prediction FROM daily),
    e AS (SELECT y, y - prediction AS err, abs(y - prediction) / greatest(abs(y), 2.220446049250313e-16) AS ape FROM p
      WHERE prediction IS NOT NULL)
    SELECT count(*) AS n, round(avg(abs(err)), 4) AS mae, round(sqrt(avg(err * err)), 4) AS rmse, round(avg(ape), 6) AS mape,
    round(1 - sum(err * err) / sum((y - m) * (y - m)), 8) AS r2 FROM e, (SELECT avg(y) AS m FROM e)""",
)
def metric_regression(spark, d):
    """Errors of the simplest forecast: tomorrow sells what today sold."""
    from pyspark.sql import Window

    previous = F.lag("daily_total").over(Window.orderBy("sale_date"))
    pairs = daily(spark, d).select(X.double("daily_total").alias("y"), X.double(previous).alias("prediction"))
    out = stats.regression_metrics(pairs.dropna())
    return rounded(rounded(rounded(out, "mae", "rmse"), "mape", digits=6), "r2", digits=8)
