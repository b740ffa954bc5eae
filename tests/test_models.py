"""Regressors, attribution, clusters, isolation forest and streaming on data with known structure."""

import datetime as dt

import numpy as np
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from tillspark.operators import attribution, cluster, isolation, model, ordering
from tillspark.plans.model_queries import ML_COLUMNS
from tillspark.sources.star import sales
from tillspark.streaming import daily as streaming


@pytest.fixture(scope="module")
def fitted(spark):
    return model.fit(sales(spark, SF_DIR, *ML_COLUMNS), model.regressors(rounds=8, trees=8))


def test_models_explain_the_target(fitted):
    table = {r.model: r for r in fitted.compare().collect()}
    assert set(table) == {"Second-Order Boosting", "Random Forest", "Gradient Boosting"}
    assert all(r.r2 > 0.5 for r in table.values())
    assert fitted.best() == max(table, key=lambda m: table[m].r2)


def test_importance_names_the_two_factors(fitted):
    top = [r.feature for r in model.importance(fitted, top_n=2).collect()]
    assert set(top) == {"quantity_sold", "price"}
    assert len(fitted.feature_names()) == fitted.test.first().features.size


@pytest.mark.parametrize("name", ["Second-Order Boosting", "Gradient Boosting", "Random Forest"])
def test_contributions_add_up_to_the_prediction(fitted, name):
    out = attribution.attributions(fitted.test.limit(40), fitted.model(name)).toPandas()
    total = out["base"] + out["contributions"].map(np.sum)
    assert np.abs(total - out["prediction"]).max() < 1e-6 * out["prediction"].abs().max()


def test_contributions_match_the_definition():
    """Against all orderings of the features, on a tree where one feature is split twice."""
    from itertools import permutations

    paths = [
        (1.0, np.array([0, 1]), np.array([-np.inf, -np.inf]), np.array([0.0, 0.0]), np.array([0.5, 0.4])),
        (4.0, np.array([0, 1]), np.array([-np.inf, 0.0]), np.array([0.0, np.inf]), np.array([0.5, 0.6])),
        (9.0, np.array([0, 2]), np.array([0.0, -np.inf]), np.array([1.0, 0.0]), np.array([0.2, 0.3])),
        (2.0, np.array([0, 2]), np.array([0.0, 0.0]), np.array([1.0, np.inf]), np.array([0.2, 0.7])),
        (7.0, np.array([0]), np.array([1.0]), np.array([np.inf]), np.array([0.3])),
    ]

    def value(row, known):
        total = 0.0
        for v, features, low, high, share in paths:
            for f, lo, hi, z in zip(features, low, high, share):
                v *= float(lo < row[f] <= hi) if f in known else z
            total += v
        return total

    for row in ([-1, 1, 0], [0.5, -1, -1], [3, 1, 1]):
        want = np.zeros(3)
        for order in permutations(range(3)):
            for i, f in enumerate(order):
                want[f] += (value(row, set(order[: i + 1])) - value(row, set(order[:i]))) / 6
        assert attribution.shapley(np.array([row], dtype=float), paths)[0] == pytest.approx(want)


def test_unseen_category_encodes_to_zeros(spark, fitted):
    lines = model.clean.calendar_features(sales(spark, SF_DIR, *ML_COLUMNS)).limit(3)
    strange = lines.withColumns({c: F.lit("never seen") for c in model.CATEGORICAL})
    ready = fitted.prepare.transform(fitted.preparation.columns(strange)).first().features.toArray()
    assert np.abs(ready[len(model.NUMERIC) :]).sum() == 0
    text = strange.withColumn("quantity_sold", F.lit("many"))
    scored = model.predict(fitted.pipeline(), text, fitted.preparation, fitted.best())
    assert scored.count() == 3 and scored.filter(F.col("predicted_sales").isNull()).count() == 0


def test_named_categories_are_hashed(spark):
    lines = model.clean.calendar_features(sales(spark, SF_DIR, "date_of_sale", *model.NUMERIC[:2], *model.CATEGORICAL))
    narrow = model.Preparation(hashed=("product_name",), hash_width=10).columns(lines)
    assert narrow.select("product_name").distinct().count() <= 10
    plain = model.Preparation().columns(lines)
    assert plain.select("product_name").distinct().count() > 10
    assert narrow.select("category").distinct().count() == plain.select("category").distinct().count()


def test_clusters_find_separate_groups(spark):
    rng = np.random.default_rng(1)
    centres = [(100.0, 2), (2000.0, 3), (150.0, 60)]
    rows = []
    for g, (spend, count) in enumerate(centres):
        for i in range(40):
            s, c = spend * (1 + 0.02 * rng.normal()), int(count * (1 + 0.02 * rng.normal()) + 0.5)
            rows.append((f"{g}-{i}", float(s), float(s / c), c, c * 2, 2.0, 5.0, float(s / c / 2)))
    df = spark.createDataFrame(rows, ["customer_name", *cluster.FEATURES])
    points = cluster.scaled(df)
    table = [r.inertia for r in cluster.elbow(points, max_k=5, starts=3).orderBy("k").collect()]
    assert all(a > b for a, b in zip(table, table[1:]))
    out = cluster.assign(points, 3, starts=3)
    groups = {r.customer_name: r.cluster for r in out.collect()}
    assert len({(n.split("-")[0], c) for n, c in groups.items()}) == 3
    labels = {r.segment_label for r in cluster.profile(out).collect()}
    assert labels == {"BIG SPENDERS (HIGH VALUE, LESS FREQUENT)", "FREQUENT SHOPPERS (REGULAR VISITORS)", "LOW-VALUE CUSTOMERS"}
    scores = cluster.project(points).toPandas()
    assert abs(scores["pc1"].mean()) < 1e-9 and scores["pc1"].var() >= scores["pc2"].var()


def test_elbow_rule():
    assert cluster.pick_k([100, 40, 30, 25]) == 2
    assert cluster.pick_k([100, 90, 80, 70]) == 3  # no bend: the default
    assert cluster.pick_k([100, 50, 50]) == 3  # nothing gained after: guarded division


def test_isolation_forest_finds_spikes(spark):
    rng = np.random.default_rng(5)
    rows = [(dt.date(2022, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(rng.normal(100, 5, 200))]
    spikes = [dt.date(2023, 1, 1) + dt.timedelta(days=i) for i in range(5)]
    rows += [(d, v) for d, v in zip(spikes, (300.0, 320.0, -80.0, 290.0, -100.0))]
    df = spark.createDataFrame(rows, "sale_date date, daily_total double")
    out = isolation.isolation_anomalies(df)
    flagged = {r.sale_date for r in out.filter("anomaly = 1").collect()}
    assert set(spikes) <= flagged and 5 <= len(flagged) <= 12
    again = isolation.isolation_anomalies(df.repartition(3))
    assert {r.sale_date for r in again.filter("anomaly = 1").collect()} == flagged
    few = isolation.isolation_anomalies(df.limit(20), min_rows=30)
    assert {(r.anomaly, r.status) for r in few.collect()} == {(None, "too_few_rows")}
    spike = spark.createDataFrame([*rows[:20], rows[-1]], "sale_date date, daily_total double")
    assert [r.sale_date for r in isolation.isolation_anomalies(spike).filter("anomaly = 1").collect()] == [spikes[-1]]


def test_positions_ignore_partitioning(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("v"))
    answers = []
    for partitions in ("1", "4", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        numbered = ordering.row_number(df.repartition(5), ["v", "id"])
        answers.append({r.id: r.row_number for r in numbered.collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert answers[0] == answers[1] == answers[2]


def test_a_value_held_by_a_third_of_the_rows_is_spread(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = [r["count"] for r in ordering._ranges(df, ["v", "id"]).groupBy("_range").count().collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == 4 and max(sizes) < 2 * 3000 / 4


def test_stream_drops_what_comes_after_the_watermark(spark, tmp_path):
    schema = "date_of_sale timestamp, category string, total_amount decimal(12,2)"
    source, state, out = (str(tmp_path / n) for n in ("in", "state", "out"))

    def arrive(*rows):
        data = [(dt.datetime.fromisoformat(t), c, v) for t, c, v in rows]
        frame = spark.createDataFrame(data, "date_of_sale timestamp, category string, v double")
        frame.select("date_of_sale", "category", F.col("v").cast("decimal(12,2)").alias("total_amount")).coalesce(1).write.mode("append").parquet(source)

    def run():
        past = spark.createDataFrame([("a", 10.0, 1.0)], "category string, baseline_mean double, baseline_std double")
        stream = streaming.read_stream(spark, source, spark.createDataFrame([], schema).schema)
        figures = streaming.daily_figures(stream, ["category"], "1 day")
        return streaming.run_available(streaming.flag_days(figures, past, ["category"]), out, state)

    arrive(("2024-01-01 10:00:00", "a", 4.0), ("2024-01-02 09:00:00", "a", 10.0))
    assert run().count() == 0  # nothing has closed
    arrive(("2024-01-01 23:00:00", "a", 5.0), ("2024-01-03 12:00:00", "a", 1.0))  # late, but inside the delay
    first = run().filter("sale_date = '2024-01-01'").first()
    assert (first.transaction_count, first.total_sales, first.z_score, first.anomaly_status) == (2, 9.0, -1.0, "Normal")
    arrive(("2024-01-01 12:00:00", "a", 99.0), ("2024-01-08 00:00:00", "a", 1.0))  # the first day has closed: dropped
    table = {str(r.sale_date): r for r in run().collect()}
    assert table["2024-01-01"].total_sales == 9.0 and table["2024-01-02"].total_sales == 10.0
    assert table["2024-01-03"].anomaly_status == "Anomaly"


def test_compared_models_are_fitted_at_once(spark):
    """Each fit waits until the others have begun, which fits one after another never do."""
    import threading

    met = threading.Barrier(2, timeout=20)

    class Waiting(model.GBTRegressor):
        def fit(self, dataset, params=None):
            met.wait()
            return super().fit(dataset, params)

    estimators = {name: Waiting(labelCol=model.TARGET, maxIter=1, maxDepth=1, seed=1) for name in ("a", "b")}
    found = model.fit(sales(spark, SF_DIR, *ML_COLUMNS), estimators)
    assert {r.model for r in found.compare().collect()} == {"a", "b"}


def test_rows_are_explained_without_sorting_them(monkeypatch):
    """What a path of a few features gives each pattern does not depend on rows, so it is not found anew for each batch."""
    paths = [(2.0, np.array([0, 1]), np.array([-np.inf, 0.0]), np.array([0.5, np.inf]), np.array([0.3, 0.6])), (1.0, np.array([], int), *np.empty((3, 0)))]
    tables = attribution.path_tables(paths)
    assert [None if t is None else t.shape for t in tables] == [(2, 4), None]
    x = np.random.default_rng(1).normal(size=(50, 2))
    monkeypatch.setattr(attribution, "_TABLED", 0)
    by_rows = attribution.shapley(x, paths)
    monkeypatch.setattr(np, "unique", None)
    assert np.array_equal(attribution.shapley(x, paths, tables), by_rows)


def test_every_line_is_predicted(spark, fitted, monkeypatch):
    """One row a line, with the figures of its category; also for lines without a category."""
    from tillspark.plans import model_queries

    lines = sales(spark, SF_DIR, *ML_COLUMNS).limit(300).withColumn("category", F.when(F.col("quantity_sold") > 10, F.col("category"))).localCheckpoint()
    monkeypatch.setattr(model_queries, "fitted", lambda *_: fitted)
    monkeypatch.setattr(model_queries, "sales", lambda *_: lines)
    out = model_queries.ml_predict(spark, SF_DIR).toPandas()
    assert len(out) == 300 and out["predicted_sales"].notna().all() and set(out["model_used"]) == {fitted.best()}
    for _, own in out.groupby("category", dropna=False):
        assert set(own["lines"]) == {len(own)} and own["category_predicted_sales"].iloc[0] == pytest.approx(own["predicted_sales"].sum())
        assert own["total_sales"].iloc[0] == pytest.approx(float(own["total_amount"].sum()))


def test_saved_pipeline_takes_lines_as_they_are(spark, tmp_path):
    """It holds all steps, the choice and hashing of columns included."""
    lines = model.clean.calendar_features(sales(spark, SF_DIR, *ML_COLUMNS))
    preparation = model.Preparation(hashed=("product_name",), hash_width=16)
    found = model.fit(sales(spark, SF_DIR, *ML_COLUMNS), model.regressors(rounds=2, trees=2), preparation)
    found.pipeline("Second-Order Boosting").write().overwrite().save(str(tmp_path / "model"))
    loaded = model.PipelineModel.load(str(tmp_path / "model"))
    some = lines.filter("transaction_id < 200").localCheckpoint()
    direct = sorted(r.prediction for r in found.model("Second-Order Boosting").transform(found.prepare.transform(preparation.columns(some))).collect())
    assert sorted(r.prediction for r in loaded.transform(some.withColumn("price", F.col("price").cast("string"))).collect()) == direct
    assert sorted(r.predicted_sales for r in model.predict(loaded, some, preparation, "any").collect()) == direct
