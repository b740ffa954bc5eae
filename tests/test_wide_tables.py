"""Profiles of whole tables, month folders, K-Means fits that move together, and sketches of days."""

import datetime as dt
from decimal import Decimal

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tillspark.operators import clean, cluster, kpi
from tillspark.sources import files


@pytest.fixture(scope="module")
def lines(spark):
    rows = [
        (i, f"c{i % 7}" if i % 5 else None, Decimal(i % 3), dt.date(2024, 1, 1) + dt.timedelta(days=i % 100), float("nan") if i == 3 else i / 4)
        for i in range(400)
    ]
    return spark.createDataFrame(rows, "id int, customer_name string, total_amount decimal(10,2), date_of_sale date, part double").repartition(5)


def test_profile_of_every_column(spark, lines):
    got = clean.profile(lines.withColumn("nothing", F.lit(None).cast("string")), samples=4).collect()
    assert [r.column_name for r in got] == [*lines.columns, "nothing"]
    told = {r.column_name: (r.data_type, r.row_count, r.null_count, r.distinct_count) for r in got}
    assert told == {"id": ("int", 400, 0, 400), "customer_name": ("string", 400, 80, 7), "total_amount": ("decimal(10,2)", 400, 0, 3),
                    "date_of_sale": ("date", 400, 0, 100), "part": ("double", 400, 0, 400), "nothing": ("string", 400, 400, 0)}
    samples = [r.samples.split(" | ") for r in got]
    assert all(len(s) == 4 for s in samples) and set(samples[-1]) == {"null"}
    known = {str(r.id): r for r in lines.collect()}
    assert all(str(known[i].total_amount) == a and str(known[i].date_of_sale) == d for i, a, d in zip(samples[0], samples[2], samples[3]))
    again = clean.profile(lines.withColumn("nothing", F.lit(None).cast("string")).repartition(2), samples=4).collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in got]
    sketched = {r.column_name: r for r in clean.profile(lines, approximate=True).collect()}
    assert sketched["customer_name"].null_count == 80 and abs(sketched["id"].distinct_count - 400) < 60
    none = clean.profile(lines.limit(0)).collect()
    assert [(r.row_count, r.null_count, r.distinct_count, r.samples) for r in none] == [(0, 0, 0, "")] * 5 or all(r.row_count == 0 for r in none)


def test_month_folders(spark, lines, tmp_path):
    path = str(tmp_path / "months")
    files.write_sales(lines, path)
    some = files.read_sales(spark, path, dt.date(2024, 2, 10), dt.date(2024, 3, 5))
    assert {f.split("sale_month=")[1][:7] for f in some.inputFiles()} >= {"2024-02", "2024-03"}
    assert "PartitionFilters: [isnotnull(sale_month" in some._jdf.queryExecution().executedPlan().toString()
    read = some.select("id", F.input_file_name().alias("f")).collect()
    assert {r.f.split("sale_month=")[1][:7] for r in read} == {"2024-02", "2024-03"}
    assert {r.id for r in read} == {r.id for r in lines.filter("date_of_sale between '2024-02-10' and '2024-03-05'").collect()}
    assert files.read_sales(spark, path).count() == 400 and files.read_sales(spark, path, last=dt.date(2024, 1, 1)).count() == 4
    spine = spark.createDataFrame([(dt.date(2024, 2, 1),), (dt.date(2024, 2, 3),), (dt.date(2024, 2, 3),)], "sale_date date").filter("sale_date > '2024-01-31'")
    on = files.sales_on(spark, path, spine)
    assert "dynamicpruning" in on._jdf.queryExecution().executedPlan().toString()
    assert {r.id for r in on.collect()} == {r.id for r in lines.filter("date_of_sale in ('2024-02-01', '2024-02-03')").collect()}
    assert {r.sale_month for r in files.last_month(spark, path).select("sale_month").collect()} == {"2024-04"}


def brute_lloyd(x, c, iterations=300, tolerance=1e-4):
    for _ in range(iterations):
        near = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([x[near == k].mean(axis=0) if (near == k).any() else c[k] for k in range(len(c))])
        if np.sqrt(((moved - c) ** 2).sum(axis=1)).max() <= tolerance:
            break
        c = moved
    return c, ((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum()


def test_fits_together_as_each_alone(spark):
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(m, 1, (60, 3)) for m in (0, 4, 9)])
    points = spark.createDataFrame([(row.tolist(),) for row in x], "x array<double>").select(array_to_vector("x").alias("features")).repartition(4)
    starts = [x[r.choice(len(x), k, replace=False)] for k in (1, 2, 3, 3, 5, 8)] + [np.array([[0.0, 0, 0], [500, 500, 500]])]  # the last keeps an empty centre
    centres, cost = cluster.lloyd(points, starts)
    for start, c, v in zip(starts, centres, cost):
        want, inertia = brute_lloyd(x, start)
        assert np.abs(c - want).max() < 1e-9 and v == pytest.approx(inertia)
    table = [r.inertia for r in cluster.elbow(points, max_k=4, starts=3).orderBy("k").collect()]
    assert table[0] == pytest.approx(((x - x.mean(axis=0)) ** 2).sum()) and sorted(table, reverse=True) == table
    assert cluster.pick_k(table) == 3 or table[2] < 0.2 * table[0]
    sizes = [r["count"] for r in cluster.assign(points, 3, starts=4).groupBy("cluster").count().collect()]
    assert sorted(sizes) == [60, 60, 60]
    assert cluster.elbow(points.limit(0)).count() == 0
    same = spark.createDataFrame([([1.0, 1.0],)] * 5, "x array<double>").select(array_to_vector("x").alias("features"))
    assert all(r.inertia == 0 for r in cluster.elbow(same, max_k=3, starts=2).collect())


def test_sketches_answer_for_any_days(spark, lines, tmp_path):
    many = spark.range(20_000).select(
        F.concat(F.lit("c"), F.pmod(F.xxhash64("id"), F.lit(3000))).alias("customer_name"), F.lit(1.5).cast("decimal(12,2)").alias("total_amount"),
        F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 60).cast("int")).alias("date_of_sale"),
    )
    path = str(tmp_path / "sketches")
    kpi.daily_sketches(many).write.parquet(path)
    table = spark.read.parquet(path)
    for first, last in (("2024-01-01", "2024-02-29"), ("2024-01-05", "2024-01-06"), ("2024-02-03", "2024-02-20")):
        got = kpi.united(table.filter(f"sale_date between '{first}' and '{last}'"))
        assert path in got.inputFiles()[0]  # no row of the sales is read
        row, want = got.first(), many.filter(f"date_of_sale between '{first}' and '{last}'").agg(F.count_distinct("customer_name"), F.count("*")).first()
        assert row.lines == want[1] and abs(row.about_distinct - want[0]) <= max(2, 0.065 * want[0])
    nobody = kpi.united(kpi.daily_sketches(lines.withColumn("customer_name", F.lit(None).cast("string")))).first()
    assert nobody.about_distinct == 0 and nobody.lines == 400


def test_points_are_spread_and_fits_plan_no_query_an_iteration(spark):
    """A customer table of one part fills all cores; the number of planned queries does not grow with the iterations."""
    rows = [(str(i), *(float((i * p) % 97) for p in (3, 5, 7, 11, 13, 17, 19))) for i in range(400)]
    points = cluster.scaled(spark.createDataFrame(rows, ["customer_name", *cluster.FEATURES]).coalesce(1))
    assert points.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    starts = cluster.starting_centres(points, [(3, 1), (4, 1)])
    store, counts = spark._jsparkSession.sharedState().statusStore(), []
    for iterations in (1, 4):
        before = store.executionsCount()
        cluster.lloyd(points, starts, iterations)
        counts.append(store.executionsCount() - before)
    assert counts[0] == counts[1]
