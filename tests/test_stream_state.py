"""The running baseline of a stream equals the batch answer, however its files are split; open days and late rows are told."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillspark.streaming import daily as streaming

SCHEMA = "date_of_sale timestamp, category string, total_amount decimal(12,2)"


def events(seed=1, days=30):
    r = np.random.default_rng(seed)
    rows = []
    for day in range(days):
        for category, scale in (("a", 100), ("b", 10), ("steady", 0)):
            for _ in range(r.integers(0, 4) if scale else 1):
                rows.append((dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=float(r.uniform(0, 23.9))), category, round(float(5 + scale * r.uniform()), 2)))
    return sorted(rows)


def put(spark, rows, folder):
    spark.createDataFrame(rows, "t timestamp, category string, v double").select(
        F.col("t").alias("date_of_sale"), "category", F.col("v").cast("decimal(12,2)").alias("total_amount")
    ).coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder):
    return streaming.read_stream(spark, folder, spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)


def told(df):
    return {(r.category, str(r.sale_date)): (r.transaction_count, r.days_before, r.anomaly_status, *(x if x is None else round(x, 6) for x in (r.total_sales, r.baseline_mean, r.baseline_std, r.z_score))) for r in df.collect()}


def batch(spark, rows, newest):
    df = spark.createDataFrame(rows, "t timestamp, category string, v double")
    days = df.groupBy("category", F.to_date("t").alias("sale_date")).agg(F.count("*").alias("transaction_count"), F.sum(F.col("v").cast("decimal(12,2)")).cast("double").alias("total_sales"))
    closed = days.filter(F.col("sale_date").cast("timestamp") + F.expr("interval 1 day") <= F.lit(newest) - F.expr("interval 1 day"))
    return streaming.running_batch(closed, ["category"], 2.0)


@pytest.mark.parametrize("cuts", [[90], [20, 55, 90]])
def test_stream_equals_batch_after_any_split(spark, tmp_path, cuts):
    rows = events()
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    edges = [0, *(len(rows) * c // 100 for c in cuts), len(rows)]
    for lo, hi in zip(edges, edges[1:]):  # a run after each arrival goes on where the last one stopped
        put(spark, rows[lo:hi], folder)
        figures = streaming.daily_figures(source(spark, folder), ["category"])
        table = streaming.run_available(streaming.flag_running(figures, ["category"], 2.0), out, state)
        want = told(batch(spark, rows, rows[hi - 1][0]))
        assert told(table) == want
    assert {v[2] for v in want.values()} == {"Normal", "Anomaly", "Unknown"} or {v[2] for v in want.values()} == {"Normal", "Unknown"}
    assert all(v[2] == "Unknown" for k, v in want.items() if k[0] == "steady") and spark.conf.get(streaming.STORE, "") != streaming.ROCKS


def test_open_days_and_late_rows(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    at = lambda text: dt.datetime.fromisoformat(text)

    def run():
        return {str(r.sale_date): r for r in streaming.days_so_far(source(spark, folder), ["category"], out, state).collect()}

    put(spark, [(at("2024-01-01 10:00:00"), "a", 4.0), (at("2024-01-02 09:00:00"), "a", 1.0)], folder)
    first = run()
    assert {k: (r.is_open, r.total_sales) for k, r in first.items()} == {"2024-01-01": (True, 4.0), "2024-01-02": (True, 1.0)}
    put(spark, [(at("2024-01-01 20:00:00"), "a", 6.0), (at("2024-01-05 00:00:00"), "a", 2.0)], folder)
    second = run()
    assert {k: (r.is_open, r.transaction_count, r.total_sales) for k, r in second.items()} == {
        "2024-01-01": (False, 2, 10.0), "2024-01-02": (False, 1, 1.0), "2024-01-05": (True, 1, 2.0)}
    put(spark, [(at("2024-01-01 21:00:00"), "a", 99.0), (at("2024-01-02 21:00:00"), "a", 99.0), (at("2024-01-05 01:00:00"), "a", 1.0)], folder)
    third = run()
    assert third["2024-01-01"].total_sales == 10.0 and third["2024-01-05"].total_sales == 3.0
    assert {(r.arrived_rows, r.late_rows) for r in third.values()} == {(7, 2)}
