"""Exact ranks by counts between bounds, against sorting."""

from decimal import Decimal

import numpy as np
import pytest

from tillspark.operators import ordering

SHARES = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)


def ranks(n):
    return {f"r{i}": int(s * (n - 1)) + 1 for i, s in enumerate(SHARES)} | {"before": 0, "behind": n + 1}


def check(spark, values, kind):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}").repartition(4)
    row = ordering.order_statistics(ordering.value_counts(df, ["v"]), ranks).first()
    whole = sorted((v for v in values if v is not None), key=lambda v: (v != v, v))
    assert row["rows"] == len(whole) and row["before"] is None and row["behind"] is None
    for i, s in enumerate(SHARES):
        want = whole[int(s * (len(whole) - 1))]
        assert row[f"r{i}"] == want or (want != want and row[f"r{i}"] != row[f"r{i}"])


def test_doubles_of_many_magnitudes(spark):
    r = np.random.default_rng(1)
    for values in (r.normal(size=3000), np.exp(r.normal(0, 60, 2000)), r.integers(0, 5, 500) * 1.0, [1.5] * 40, [-1e308, 1e308, 0.0, 5e-324, -5e-324]):
        check(spark, [float(v) for v in values], "double")


def test_nan_infinities_and_nulls(spark):
    values = [float("nan")] * 5 + [float("inf")] * 3 + [float("-inf")] * 4 + [None] * 6 + [float(i) for i in range(30)]
    check(spark, values, "double")
    check(spark, [float("nan"), float("inf"), float("-inf")], "double")


def test_decimals_and_integers(spark):
    r = np.random.default_rng(2)
    check(spark, [Decimal(int(x)) / 100 for x in r.integers(-(10**11), 10**11, 1500)], "decimal(14,2)")
    check(spark, [int(x) for x in r.integers(-(2**62), 2**62, 1500)], "bigint")
    check(spark, [2**62, 2**62 + 1, 2**62 + 2, -(2**62)], "bigint")  # closer than doubles can tell


def test_a_hot_value_and_several_columns(spark):
    rows = [(7.0 if i % 3 else float(i), i % 4, f"{i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "`it's` double, b int, c string")
    counts = ordering.value_counts(df, ["it's", "b"])
    found = {r.metric: (r.rows, r.m) for r in ordering.order_statistics(counts, lambda n: {"m": n // 2 + 1}).collect()}
    assert found == {"it's": (2000, sorted(r[0] for r in rows)[1000]), "b": (2000, 2)}
    between = {r.metric: r.q for r in ordering.quantiles(counts, {"q": 0.3}).collect()}
    assert between["it's"] == pytest.approx(np.quantile([r[0] for r in rows], 0.3)) and between["b"] == pytest.approx(np.quantile([r[1] for r in rows], 0.3))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_no_rows(spark):
    empty = ordering.value_counts(spark.createDataFrame([(None,)], "v double"), ["v"])
    assert ordering.order_statistics(empty, ranks).count() == 0 and ordering.quantiles(empty, {"q": 0.5}).count() == 0


def test_rank_of_a_value_that_fills_several_ranges(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(5)
    values = [None if x == 0 else float(x) for x in r.integers(0, 6, 900)] + [2.5] * 1500 + [float(x) for x in range(10, 90)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = ordering.rank(df, F.desc("v"), "v")
        got = {x.id: x["rank"] for x in ranked.collect()}
        sizes = [x["count"] for x in ordering._ranges(df, [F.desc("v"), F.xxhash64("id", "v")]).groupBy("_range").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    down = sorted((v for v in values if v is not None), reverse=True) + [None] * values.count(None)
    assert got == {i: down.index(v) + 1 for i, v in enumerate(values)} and ranked.columns == ["id", "v", "rank"]
    assert len(sizes) == 4 and max(sizes) < 2 * len(values) / 4


def test_fits_are_made_anew_once_a_table_is_written_again(spark, tmp_path):
    from tillspark.plans import model_queries

    made = []
    spark.range(3).write.parquet(str(tmp_path / "t"))
    for _ in range(2):
        model_queries.once(spark, str(tmp_path), "x", lambda: made.append(1))
    assert len(made) == 1
    spark.range(4).write.mode("overwrite").parquet(str(tmp_path / "t"))
    model_queries.once(spark, str(tmp_path), "x", lambda: made.append(1))
    assert len(made) == 2
