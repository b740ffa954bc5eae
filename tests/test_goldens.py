"""Small hand-made frames with known answers."""

import datetime as dt
from decimal import Decimal
from itertools import product

import pytest
from pyspark.sql import functions as F

from tillspark import schemas
from tillspark.functions import exprs as X
from tillspark.operators import anomaly, clean, forecast, kpi, ordering, segment, series, stats
from tillspark.sources import files, star


def day(n: int, month: int = 1, year: int = 2023) -> dt.date:
    return dt.date(year, month, n)


def daily_frame(spark, rows):
    return spark.createDataFrame([(d, Decimal(str(v))) for d, v in rows], "sale_date date, daily_total decimal(12,2)")


@pytest.fixture(scope="module")
def gaps(spark):
    return daily_frame(spark, [(day(1), 10), (day(2), 20), (day(5), 30), (day(9), 40)])


def test_calendar_means_skip_missing_days(gaps):
    out = [r.moving_avg_7 for r in series.moving_averages(gaps, (7,)).orderBy("sale_date").collect()]
    assert out == [10, 15, 20, 35]


def test_lags_are_calendar_lags(gaps):
    out = series.lag_features(gaps).orderBy("sale_date").collect()
    assert [r.sales_lag1 for r in out] == [None, 10, None, None]
    assert [r.sales_lag3 for r in out] == [None, None, 20, None]
    assert [r.moving_avg_7day for r in out] == [None, 10, 15, 25]


def test_row_frames_differ_from_calendar_frames(gaps):
    out = series.rolling(gaps, "sale_date", "daily_total", 3).orderBy("sale_date").collect()
    assert [r.rolling_mean_3 for r in out] == [None, None, 20, 30]


def test_zero_fill_keeps_sum_and_covers_every_day(gaps):
    out = series.zero_fill(gaps).orderBy("sale_date").collect()
    assert [r.sale_date for r in out] == [day(n) for n in range(1, 10)]
    assert sum(r.daily_total for r in out) == 100


def test_month_series_fills_empty_months(spark):
    months = spark.createDataFrame([(2022, 11, 5.0), (2023, 2, 7.0)], "year int, month int, monthly_total double")
    out = series.month_series(months).orderBy("ds").collect()
    assert [(r.ds, r.y) for r in out] == [
        (dt.date(2022, 11, 30), 5), (dt.date(2022, 12, 31), 0), (dt.date(2023, 1, 31), 0), (dt.date(2023, 2, 28), 7)
    ]


def test_dirty_numbers_and_median(spark):
    raw = spark.createDataFrame(
        [("1", "10", "5"), ("abc", "20", ""), ("3", None, "7"), ("5", "x", "9")],
        "quantity_sold string, price string, total_amount string",
    )
    numbers = clean.to_numeric(raw)
    before = kpi.missing_values(numbers).first()
    assert (before.quantity_sold_nulls, before.price_nulls, before.total_amount_nulls, before.total_rows) == (1, 2, 1, 4)
    filled = clean.impute_median(numbers)
    assert sorted(r.quantity_sold for r in filled.collect()) == [1, 3, 3, 5]
    assert sorted(r.price for r in filled.collect()) == [10, 15, 15, 20]
    assert kpi.missing_values(filled).first().price_nulls == 0


def test_zero_denominators(spark):
    equal = daily_frame(spark, [(day(n), 5) for n in range(1, 6)])
    assert anomaly.zscore_anomalies(equal, 0).count() == 0
    assert spark.range(1).select(X.ratio(F.lit(1), F.lit(0)).alias("r")).first().r is None
    months = spark.createDataFrame(
        [(2022, 1, Decimal(0)), (2023, 1, Decimal(5))], "year int, month int, monthly_total decimal(12,2)"
    )
    last = kpi.year_over_year(months).collect()[-1]
    assert (last.prev_year_sales, last.yoy_difference, last.yoy_growth_pct) == (0, 5, None)


def test_three_median_rules(spark):
    for n, upper, between in ((4, 3, 2.5), (5, 3, 3)):
        df = spark.createDataFrame([(i,) for i in range(1, n + 1)], "v int")
        counts = ordering.value_counts(df, ["v"])
        assert ordering.order_statistics(counts, lambda k: {"m": k // 2 + 1}).first().m == upper
        assert ordering.quantiles(counts, {"m": 0.5}).first().m == between
        assert ordering.order_statistics(counts, lambda k: {"m": int(k * 0.25)}).first().m == 1


def test_quartile_rule_needs_four_days(spark):
    assert anomaly.iqr_anomalies(daily_frame(spark, [(day(1), 1), (day(2), 2), (day(3), 1000)])).count() == 0


def test_quartile_fences(spark):
    rows = [(day(n), 100 + n) for n in range(1, 21)] + [(day(25), 900), (day(26), -700)]
    out = {r.sale_date: r.anomaly_status for r in anomaly.iqr_anomalies(daily_frame(spark, rows)).collect()}
    assert out == {day(25): "High Outlier", day(26): "Low Outlier"}


@pytest.mark.parametrize("n", [3, 5, 7, 1503])
def test_ntile_with_ties(spark, n):
    df = spark.createDataFrame([(i, i % 4) for i in range(n)], "id int, v int")
    mine = ordering.ntile(df, ["v", "id"], 5)
    df.createOrReplaceTempView("ties")
    want = spark.sql("SELECT id, ntile(5) OVER (ORDER BY v, id) AS tile FROM ties")
    assert {r.id: r.tile for r in mine.collect()} == {r.id: r.tile for r in want.collect()}


def test_rfm_labels_over_all_scores(spark):
    grid = spark.createDataFrame(list(product(range(1, 6), repeat=3)), "r int, f int, m int")
    labels = grid.select(segment.rfm_label(F.col("r"), F.col("f"), F.col("m")).alias("s"))
    counts = {r.s: r["count"] for r in labels.groupBy("s").count().collect()}
    assert counts == {
        "Potential Loyalists": 33, "Others": 23, "Loyal Customers": 19, "At Risk Customers": 18,
        "Need Attention": 14, "Champions": 8, "Hibernating": 6, "New Customers": 4,
    }


def test_customer_segments_in_order(spark):
    rows = []

    def customer(name, count, spend, age):
        date = dt.datetime(2024, 1, 1) - dt.timedelta(days=age)
        rows.extend((name, date, 1, Decimal(str(round(spend / count, 2)))) for _ in range(count))

    for name, count, spend, age in (
        ("hvl", 10, 1000, 30), ("loyal", 10, 900, 5), ("big", 2, 1000, 1), ("recent", 1, 5, 30), ("frequent", 12, 50, 31),
        ("high", 2, 2000, 400), ("churned", 2, 20, 181), ("average", 2, 20, 180),
    ):
        customer(name, count, spend, age)
    df = spark.createDataFrame(rows, "customer_name string, date_of_sale timestamp, quantity_sold int, total_amount decimal(12,2)")
    out = {r.customer_name: r.customer_segment for r in segment.customer_metrics(df, "2024-01-01").collect()}
    assert out == {
        "hvl": "High-Value Loyal", "loyal": "Loyal", "big": "Big Spender", "recent": "Recent Customer",
        "frequent": "Frequent Customer", "high": "High Spender", "churned": "Churned", "average": "Average Customer",
    }


def test_lifetime_value_of_a_single_day(spark):
    df = spark.createDataFrame(
        [("a", dt.date(2023, 1, 1), 10.0), ("b", dt.date(2023, 1, 1), 10.0), ("b", dt.date(2023, 1, 11), 10.0)],
        "customer_name string, date_of_sale date, total_amount double",
    )
    out = {r.customer_name: (r.spend_per_day, r.annual_value, r.estimated_3year_ltv) for r in segment.lifetime_value(df).collect()}
    assert out == {"a": (10, 3650, 10950), "b": (2, 730, 2190)}


def brute_pairs(rows, distinct):
    baskets = {}
    for basket, item in rows:
        baskets.setdefault(basket, []).append(item)
    found = {}
    for items in baskets.values():
        items = sorted(set(items)) if distinct else items
        for a in items:
            for b in items:
                if a < b:
                    found[a, b] = found.get((a, b), 0) + 1
    return found


@pytest.mark.parametrize("distinct", [False, True])
@pytest.mark.parametrize("block", [3, 1000])
def test_pairs_of_a_hot_basket(spark, distinct, block):
    rows = [(1, f"p{i % 17:02d}") for i in range(60)] + [(2, "p01"), (2, "p02"), (2, "p01"), (3, "p05")]
    df = spark.createDataFrame(rows, "transaction_id int, product_name string")
    _, pairs = segment.item_pairs(df, distinct_items=distinct, block=block)
    out = {(r.product_a, r.product_b): r.s for r in pairs.groupBy("product_a", "product_b").agg(F.sum("n").alias("s")).collect()}
    assert out == brute_pairs(rows, distinct)


def test_affinity_needs_more_than_the_minimum(spark):
    rows = [(i, p) for i in range(6) for p in ("a", "b")] + [(i, p) for i in range(10, 15) for p in ("c", "d")] + [(99, "e")]
    out = segment.product_affinity(spark.createDataFrame(rows, "transaction_id int, product_name string")).collect()
    assert [(r.product_a, r.product_b, r.pair_frequency) for r in out] == [("a", "b", 6)]
    assert out[0].pct_of_transactions == pytest.approx(600 / 12)


def test_price_buckets_at_their_borders(spark):
    df = spark.createDataFrame([(None,), (9.99,), (10.0,), (25.0,), (50.0,), (100.0,)], "price double")
    out = [r.b for r in df.select(X.price_bucket("price").alias("b")).collect()]
    assert out == ["Over $100", "Under $10", "$10-$25", "$25-$50", "$50-$100", "Over $100"]


def test_rank_shares_places(spark):
    df = spark.createDataFrame([("a", 5), ("b", 9), ("c", 9), ("d", 1)], "name string, v int")
    out = {r.name: r["rank"] for r in ordering.rank(df, F.desc("v"), "v").collect()}
    assert out == {"a": 3, "b": 1, "c": 1, "d": 4}


def test_naive_forecast_offsets_and_cap(spark):
    df = daily_frame(spark, [(day(n), n) for n in range(1, 11)])
    out = forecast.naive_forecast(df, 45, capped=True).orderBy("forecast_date").collect()
    assert len(out) == 30 and out[0].forecast_date == day(10)
    assert (out[0].forecast_7day_avg, out[0].forecast_30day_avg) == (7, 5.5)
    assert out[0].weighted_forecast == pytest.approx(7 * 0.7 + 5.5 * 0.3)
    free = forecast.naive_forecast(df, 45, start_offset=1).orderBy("forecast_date").collect()
    assert len(free) == 45 and free[0].forecast_date == day(11)
    assert forecast.naive_forecast(df, 0).count() == 0


def test_date_dimension(spark):
    out = series.date_dimension(spark, "2023-12-30", "2024-01-02").orderBy("date_id").collect()
    assert [(r.date_id.day, r.day_of_week, r.week_of_year, r.is_weekend, r.is_holiday) for r in out] == [
        (30, 7, 52, True, None), (31, 1, 52, True, None), (1, 2, 1, False, None), (2, 3, 1, False, None)
    ]


def test_numeric_summary_matches_pandas(spark):
    import pandas as pd

    values = [1.0, 2.0, 2.0, 3.5, 10.0, 4.0, 7.25]
    out = stats.numeric_summary(spark.createDataFrame([(v,) for v in values] + [(None,)], "v double"), ["v"]).first()
    s = pd.Series(values)
    assert out.mean == pytest.approx(s.mean()) and out.std_dev == pytest.approx(s.std())
    assert out.skewness == pytest.approx(s.skew()) and out.kurtosis == pytest.approx(s.kurtosis())
    assert (out.q1, out.median, out.q3) == pytest.approx(tuple(s.quantile([0.25, 0.5, 0.75])))
    assert (out.missing_values, out.missing_pct) == (1, 12.5)


def test_order_statistics_of_several_columns_distributed(spark):
    df = spark.range(1001).select((F.col("id") % 10).cast("int").alias("a"), (1000 - F.col("id")).cast("int").alias("b"))
    counts = ordering.value_counts(df.withColumn("c", F.when(F.col("a") > 4, F.col("b"))), ["a", "b", "c"])
    out = {r.metric: (r.rows, r.m) for r in ordering.quantiles(counts, {"m": 0.5}).collect()}
    assert out["a"] == (1001, 4) and out["b"] == (1001, 500)
    c = sorted(1000 - i for i in range(1001) if i % 10 > 4)
    assert out["c"] == (len(c), (c[len(c) // 2] + c[(len(c) - 1) // 2]) / 2)


def test_split_ignores_partitioning(spark):
    df = spark.range(2000).withColumn("x", F.col("id") * 3)
    first = {r.id: r.part for r in clean.split_random(df.repartition(1)).collect()}
    second = {r.id: r.part for r in clean.split_random(df.repartition(7)).collect()}
    assert first == second
    assert 0.75 < sum(p == "train" for p in first.values()) / 2000 < 0.85


def test_csv_round_trip_with_bad_numbers(spark, tmp_path):
    path = tmp_path / "export.csv"
    headers = list(files.CSV_HEADERS)
    lines = [",".join(headers)]
    lines.append("1,Ann,Lamp,Home,two,9.50,19.00,Card,Rome,2023-05-01T00:00:00.000,In Stock,Bob,Sales")
    path.write_text("\n".join(lines) + "\n")
    row = files.read_csv(spark, str(path)).first()
    assert row.quantity_sold is None and row.price == Decimal("9.50") and row.date_of_sale == dt.date(2023, 5, 1)


def test_records_must_be_whole(spark):
    assert files.records_frame(spark, [{"date": "2023-01-01", "sales": 5}]).first().sales == 5
    with pytest.raises(ValueError):
        files.records_frame(spark, [{"date": "2023-01-01"}])
    bad = spark.createDataFrame([('{"date": "2023-01-01"}',)], "r string")
    with pytest.raises(Exception, match="records must contain"):
        files.parse_records(bad, "r").collect()


def test_written_sales_are_partitioned_by_month(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.date(2023, 1, 5)), (2, dt.date(2023, 2, 7))], "id int, date_of_sale date")
    files.write_sales(df, str(tmp_path / "sales"))
    assert (tmp_path / "sales" / "sale_month=2023-02").is_dir()
    assert spark.read.parquet(str(tmp_path / "sales")).filter("sale_month = '2023-01'").count() == 1


def test_declared_tables_take_typed_rows(spark):
    rows = [("T9", "Ann", "Bob", "2024-03-01 09:30:00", "P9", "Lamp", "Home", "2", "9.5", "19", "S1", "Cash")]
    text = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in schemas.SALES_TRANSACTIONS.names))
    typed = schemas.conform(text, schemas.SALES_TRANSACTIONS)
    assert typed.schema == schemas.SALES_TRANSACTIONS
    row = kpi.hourly_overview(typed).first()
    assert (row.hour_of_day, row.total_items_sold, row.total_sales) == (9, 2, 19.0)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        schemas.conform(text.withColumn("price", F.lit("dear")), schemas.SALES_TRANSACTIONS).collect()


def test_hot_order_and_hot_customer_keep_every_line(spark, tmp_path):
    """A third of all lines on one order of one customer: figures equal those of plain Python."""
    lines = [(0 if i % 3 == 0 else i, i % 5, i % 4, float(1 + i % 7), float(10 * (1 + i % 7))) for i in range(900)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    orders = [(k, 0 if k == 0 else k % 9, dt.datetime(2024, 1, 1 + k % 20)) for k in range(900)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(k, f"c{k}") for k in range(9)], "c_custkey long, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    fact = star.sales(spark, str(tmp_path), "customer_name", "date_of_sale", "quantity_sold", "total_amount")
    got = {r.customer_name: r.total_spend for r in kpi.customer_ranking(fact).collect()}
    by_day = {r.sale_date: float(r.daily_total) for r in series.daily_totals(star.order_amounts(spark, str(tmp_path), "date_of_sale")).collect()}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    days = {}
    for order, *_, amount in lines:
        date = dt.date(2024, 1, 1 + order % 20)
        days[date] = days.get(date, 0) + amount
    assert by_day == days
    want = {}
    for order, _, _, _, amount in lines:
        name = f"c{0 if order == 0 else order % 9}"
        want[name] = want.get(name, 0) + amount
    assert got == want


def test_every_year_and_day_is_kept(spark):
    months = spark.createDataFrame([(1989, 5, 1), (2003, 1, 7), (2003, 5, 9)], "year int, month int, monthly_total int")
    out = kpi.year_month_table(months)
    assert out.columns == ["month", "y1989", "y2003"]
    assert [tuple(r) for r in out.collect()] == [(1, None, 7), (5, 1, 9)]
    sold = spark.createDataFrame([(day(3),), (day(5),)], "date_of_sale date")
    assert series.date_bounds(sold, 1) == (day(2).isoformat(), day(6).isoformat())
    assert series.date_bounds(sold.limit(0)) == ("1970-01-01", "1970-01-01")


def test_rank_keeps_null_sums(spark):
    rows = spark.createDataFrame([("a", 5), ("b", None), ("c", 5), ("d", 1)], "employee string, v int")
    out = ordering.rank(rows, F.col("v").desc_nulls_last(), "v")
    assert {r.employee: r["rank"] for r in out.collect()} == {"a": 1, "c": 1, "d": 3, "b": 4}


def test_short_series_have_a_status(spark):
    months = [(dt.date(2020 + m // 12, m % 12 + 1, 28), 100.0 + m) for m in range(30)]
    rows = [("long", d, y, i) for i, (d, y) in enumerate(months)] + [("short", *months[0], 0)]
    df = spark.createDataFrame(rows, "k string, ds date, y double, t int")
    for out in (forecast.additive_forecast(df, ["k"], 3), forecast.additive_backtest(df, ["k"])):
        found = {(r.k, r.status, r.forecast is None) for r in out.collect()}
        assert found == {("long", "ok", False), ("short", "too_short", True)}
    picked = spark.createDataFrame([("long", [0, 1, 0, 0, 0, 0, 12], "ok"), ("short", None, "too_short")], "k string, order array<int>, status string")
    out = forecast.sarima_future(df, picked, ["k"], 2).collect()
    assert sorted((r.k, r.status, r.forecast is None) for r in out) == [("long", "ok", False)] * 2 + [("short", "too_short", True)]


def test_unknown_days_are_not_normal(spark):
    from tillspark.streaming import daily as streaming

    figures = spark.createDataFrame([("a", 9.0), ("b", 1.0)], "k string, total_sales double")
    past = spark.createDataFrame([("a", 1.0, 2.0)], "k string, baseline_mean double, baseline_std double")
    out = streaming.flag_days(figures, past, ["k"]).collect()
    assert {r.k: r.anomaly_status for r in out} == {"a": "Anomaly", "b": "Unknown"}
