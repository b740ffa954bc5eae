"""Daily and monthly series: spines, calendar frames, lags, decomposition, autocorrelation, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillspark.functions import exprs as X
from tillspark.operators import anomaly, forecast, kpi, ordering, series, stats
from tillspark.plans.kpi_queries import daily, monthly
from tillspark.plans.registry import query, rounded
from tillspark.schemas import NUMERIC_COLUMNS
from tillspark.session import materialise
from tillspark.sources.star import sales

D = "CAST(daily_total AS DOUBLE)"


def mean_between(first: int, last: int) -> str:
    """Correlated average over the days ``first`` to ``last`` relative to the outer row's day."""
    return f"""(SELECT CAST(sum(i.daily_total) AS DOUBLE) / count(*) FROM daily i
    WHERE i.sale_date >= a.sale_date + INTERVAL ({first}) DAY AND i.sale_date <= a.sale_date + INTERVAL ({last}) DAY)"""


@query(
    "ts_moving_avg",
    f"""SELECT a.sale_date, CAST(a.daily_total AS DOUBLE) AS daily_sales, {mean_between(-6, 0)} AS moving_avg_7,
    {mean_between(-29, 0)} AS moving_avg_30 FROM daily a""",
)
def ts_moving_avg(spark, d):
    return series.moving_averages(daily(spark, d)).orderBy("sale_date")


KEYED_DAILY = (
    "kd AS (SELECT category, d AS sale_date, sum(total_amount) AS daily_total FROM sales GROUP BY 1, 2)"
)


@query(
    "ts_moving_avg_by_category",
    f"""WITH {KEYED_DAILY} SELECT a.category, a.sale_date, CAST(a.daily_total AS DOUBLE) AS daily_sales,
    (SELECT CAST(sum(i.daily_total) AS DOUBLE) / count(*) FROM kd i WHERE i.category = a.category
     AND i.sale_date BETWEEN a.sale_date - INTERVAL 6 DAY AND a.sale_date) AS moving_avg_7 FROM kd a""",
)
def ts_moving_avg_by_category(spark, d):
    keyed = series.daily_totals(sales(spark, d, "category", "date_of_sale", "total_amount"), ["category"])
    return series.moving_averages(keyed, (7,), ["category"])


LAGS = (1, 2, 3, 7, 14, 30)
LAG_COLUMNS = ", ".join(f"CAST(l{k}.daily_total AS DOUBLE) AS sales_lag{k}" for k in LAGS)
LAG_JOINS = " ".join(f"LEFT JOIN daily l{k} ON a.sale_date = l{k}.sale_date + INTERVAL {k} DAY" for k in LAGS)


@query(
    "ts_lag_features",
    f"""SELECT a.sale_date, CAST(a.daily_total AS DOUBLE) AS daily_total, {LAG_COLUMNS},
    {mean_between(-7, -1)} AS moving_avg_7day, {mean_between(-30, -1)} AS moving_avg_30day FROM daily a {LAG_JOINS}""",
)
def ts_lag_features(spark, d):
    return series.lag_features(daily(spark, d)).orderBy("sale_date")


@query("join_left_lag", f"SELECT a.sale_date, CAST(a.daily_total AS DOUBLE) AS daily_total, {LAG_COLUMNS} FROM daily a {LAG_JOINS}")
def join_left_lag(spark, d):
    return series.lag_features(daily(spark, d), windows=())


@query(
    "join_band_correlated",
    f"""SELECT a.sale_date, CAST(a.daily_total AS DOUBLE) AS daily_total, {mean_between(-7, -1)} AS moving_avg_7day,
    {mean_between(-30, -1)} AS moving_avg_30day FROM daily a""",
)
def join_band_correlated(spark, d):
    return series.lag_features(daily(spark, d), lags=())


@query(
    "join_left_equi_arith",
    """SELECT a.year, a.month, CAST(b.monthly_total AS DOUBLE) AS prev_year_sales FROM monthly a
    LEFT JOIN monthly b ON a.year = b.year + 1 AND a.month = b.month""",
)
def join_left_equi_arith(spark, d):
    return kpi.year_over_year(monthly(spark, d)).select("year", "month", "prev_year_sales")


SPINE_SQL = """SELECT CAST(g AS DATE) AS sale_date, coalesce(CAST(daily_total AS DOUBLE), 0) AS daily_sales
    FROM generate_series((SELECT CAST(min(sale_date) AS TIMESTAMP) FROM daily),
      (SELECT CAST(max(sale_date) AS TIMESTAMP) FROM daily), INTERVAL 1 DAY) t(g)
    LEFT JOIN daily ON daily.sale_date = CAST(g AS DATE)"""


@query("ts_zero_fill", SPINE_SQL)
def ts_zero_fill(spark, d):
    filled = series.zero_fill(daily(spark, d))
    return filled.select("sale_date", X.double("daily_total").alias("daily_sales")).orderBy("sale_date")


@query("join_left_spine", SPINE_SQL)
def join_left_spine(spark, d):
    """The calendar form: every day of a date dimension inside the bounds, joined to its total."""
    totals = materialise(daily(spark, d))
    first, last = series.date_bounds(totals, 31, "sale_date")
    days = series.date_dimension(spark, first, last).select("date_id")
    first_last = totals.agg(F.struct(F.min("sale_date").alias("low"), F.max("sale_date").alias("high")))
    inside = days.withColumn("b", first_last.scalar()).filter(F.col("date_id").between(F.col("b.low"), F.col("b.high")))
    joined = inside.join(totals, inside.date_id == totals.sale_date, "left")
    return joined.select(
        F.col("date_id").alias("sale_date"), F.coalesce(X.double("daily_total"), F.lit(0.0)).alias("daily_sales")
    )


@query(
    "agg_resample_month",
    """SELECT last_day(CAST(g AS DATE)) AS ds, coalesce(CAST(monthly_total AS DOUBLE), 0) AS y
    FROM generate_series((SELECT CAST(date_trunc('month', min(d)) AS TIMESTAMP) FROM sales),
      (SELECT CAST(date_trunc('month', max(d)) AS TIMESTAMP) FROM sales), INTERVAL 1 MONTH) t(g)
    LEFT JOIN monthly ON year = year(g) AND month = month(g)""",
)
def agg_resample_month(spark, d):
    return series.month_series(monthly(spark, d)).select("ds", "y")


@query(
    "snk_date_dim",
    """SELECT CAST(g AS DATE) AS date_id, year(g) AS year, month(g) AS month, day(g) AS day, dayofweek(g) + 1 AS day_of_week,
    quarter(g) AS quarter, weekofyear(g) AS week_of_year, dayofweek(g) IN (0, 6) AS is_weekend, CAST(NULL AS BOOLEAN) AS is_holiday
    FROM generate_series((SELECT CAST(min(d) AS TIMESTAMP) FROM sales), (SELECT CAST(max(d) AS TIMESTAMP) FROM sales),
      INTERVAL 1 DAY) t(g)""",
)
def snk_date_dim(spark, d):
    """Date dimension over the days the sales table spans, written and read back."""
    from tillspark.sources.files import write_table

    bounds = sales(spark, d, "date_of_sale").agg(F.min(X.as_date("date_of_sale")).alias("a"), F.max(X.as_date("date_of_sale")).alias("b"))
    days = bounds.select(F.explode(F.sequence("a", "b")).alias("date_id"))
    return write_table(series.calendar_columns(days, "date_id"), name="dim-dates")


# ---- row frames ------------------------------------------------------------------------------------------------------


@query(
    "ts_rolling",
    f"""WITH r AS (SELECT sale_date, {D} AS daily_total, CAST(sum(daily_total) OVER w AS DOUBLE) / 7 AS m, count(*) OVER w AS n
    FROM daily WINDOW w AS (ORDER BY sale_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
    SELECT sale_date, daily_total, CASE WHEN n = 7 THEN m END AS rolling_mean_7 FROM r""",
)
def ts_rolling(spark, d):
    out = series.rolling(daily(spark, d), "sale_date", "daily_total", 7)
    return out.withColumn("daily_total", X.double("daily_total"))


@query(
    "win_rolling_rows",
    """WITH r AS (SELECT year, month, CAST(sum(monthly_total) OVER w AS DOUBLE) / 12 AS m,
      stddev_samp(CAST(monthly_total AS DOUBLE)) OVER w AS s, count(*) OVER w AS n FROM monthly
      WINDOW w AS (ORDER BY year, month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
    SELECT year, month, round(CASE WHEN n = 12 THEN m END, 4) AS rolling_mean_12,
    round(CASE WHEN n = 12 THEN s END, 4) AS rolling_std_12 FROM r""",
)
def win_rolling_rows(spark, d):
    months = monthly(spark, d).withColumn("t", F.col("year") * 12 + F.col("month"))
    out = series.rolling(months, "t", "monthly_total", 12, spread=True)
    return rounded(out.select("year", "month", "rolling_mean_12", "rolling_std_12"), "rolling_mean_12", "rolling_std_12")


@query(
    "win_range_days",
    f"""SELECT sale_date, CAST(sum(daily_total) OVER w AS DOUBLE) / count(*) OVER w AS moving_avg_14 FROM daily
    WINDOW w AS (ORDER BY sale_date RANGE BETWEEN INTERVAL 13 DAY PRECEDING AND CURRENT ROW)""",
)
def win_range_days(spark, d):
    return series.moving_averages(daily(spark, d), (14,)).drop("daily_sales")


@query(
    "win_lag",
    """SELECT year, month, CAST(lag(monthly_total) OVER (ORDER BY year, month) AS DOUBLE) AS previous_month FROM monthly""",
)
def win_lag(spark, d):
    from pyspark.sql import Window

    previous = F.lag("monthly_total").over(Window.orderBy("year", "month"))
    return monthly(spark, d).select("year", "month", X.double(previous).alias("previous_month"))


@query(
    "win_row_number",
    "SELECT sale_date, row_number() OVER (ORDER BY daily_total, sale_date) AS row_num FROM daily",
)
def win_row_number(spark, d):
    numbered = ordering.row_number(daily(spark, d), ["daily_total", "sale_date"], "row_num")
    return numbered.select("sale_date", "row_num")


# ---- orders, top-k, sets ---------------------------------------------------------------------------------------------


@query("sort_series", f"SELECT sale_date, {D} AS daily_sales FROM daily ORDER BY sale_date")
def sort_series(spark, d):
    return daily(spark, d).select("sale_date", X.double("daily_total").alias("daily_sales")).orderBy("sale_date")


@query(
    "sort_multi",
    """SELECT employee_name, product_name, count(*) AS lines FROM sales GROUP BY 1, 2
    ORDER BY employee_name, lines DESC, product_name""",
)
def sort_multi(spark, d):
    counted = kpi.group(sales(spark, d, "employee_name", "product_name"), ["employee_name", "product_name"], lines=X.rows())
    return counted.orderBy("employee_name", F.desc("lines"), "product_name")


@query(
    "sort_case",
    """SELECT payment_method, count(*) AS lines FROM sales GROUP BY 1
    ORDER BY CASE WHEN payment_method LIKE '1%' THEN 1 WHEN payment_method LIKE '2%' THEN 2 ELSE 3 END, payment_method""",
)
def sort_case(spark, d):
    urgency = F.when(F.col("payment_method").startswith("1"), 1).when(F.col("payment_method").startswith("2"), 2).otherwise(3)
    counted = kpi.group(sales(spark, d, "payment_method"), ["payment_method"], lines=X.rows())
    return counted.orderBy(urgency, "payment_method")


Z_SQL = f"(SELECT avg({D}) AS m, stddev_pop({D}) AS sd FROM daily) s"


@query(
    "sort_abs",
    f"SELECT sale_date, round(({D} - m) / sd, 6) AS z_score FROM daily, {Z_SQL} ORDER BY abs(({D} - m) / sd) DESC, sale_date LIMIT 20",
)
def sort_abs(spark, d):
    far = anomaly.zscores(daily(spark, d)).orderBy(F.desc(F.abs("z_score")), "sale_date").limit(20)
    return rounded(far.select("sale_date", "z_score"), "z_score", digits=6)


@query("topk", f"SELECT sale_date, {D} AS daily_sales FROM daily ORDER BY sale_date DESC LIMIT 30")
def topk(spark, d):
    newest = daily(spark, d).orderBy(F.desc("sale_date")).limit(30)
    return newest.select("sale_date", X.double("daily_total").alias("daily_sales"))


@query(
    "nth",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS metric, (SELECT CAST({c} AS DOUBLE) FROM sales ORDER BY {c} LIMIT 1
        OFFSET (SELECT count(*) // 2 FROM sales)) AS upper_median"""
        for c in NUMERIC_COLUMNS
    ),
)
def nth(spark, d):
    counts = ordering.value_counts(sales(spark, d, *NUMERIC_COLUMNS), NUMERIC_COLUMNS)
    picked = ordering.order_statistics(counts, lambda n: {"upper_median": n // 2 + 1})
    return picked.select("metric", X.double("upper_median").alias("upper_median"))


@query(
    "set_union_all",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS metric, count({c}) AS lines, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high FROM sales"""
        for c in NUMERIC_COLUMNS
    ),
)
def set_union_all(spark, d):
    """Three branches stacked from one aggregation instead of three scans."""
    lines = sales(spark, d, *NUMERIC_COLUMNS)
    figures = lines.agg(*(F.struct(F.lit(c).alias("metric"), F.count(c).alias("lines"), X.double(F.min(c)).alias("low"), X.double(F.max(c)).alias("high")).alias(c) for c in NUMERIC_COLUMNS))
    return figures.select(F.inline(F.array(*NUMERIC_COLUMNS)))


@query(
    "set_union_distinct",
    "SELECT product_name AS name FROM sales UNION SELECT category FROM sales UNION SELECT location FROM sales",
)
def set_union_distinct(spark, d):
    columns = ("product_name", "category", "location")
    return sales(spark, d, *columns).select(F.explode(F.array(*columns)).alias("name")).distinct()


# ---- scalar functions ------------------------------------------------------------------------------------------------


@query(
    "fn_date_parts",
    """SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd, quarter(o_orderdate) AS q,
    hour(o_orderdate) AS h, dayofweek(o_orderdate) + 1 AS sunday_first, isodow(o_orderdate) - 1 AS monday_first,
    weekofyear(o_orderdate) AS iso_week, strftime(o_orderdate, '%Y-%m') AS ym FROM orders""",
    sales=False,
)
def fn_date_parts(spark, d):
    from tillspark.plans.cleaning_queries import dated_orders

    ts = "date_of_sale"
    return dated_orders(spark, d).select(
        "o_orderkey", F.year(ts).alias("y"), F.month(ts).alias("m"), F.dayofmonth(ts).alias("dd"), F.quarter(ts).alias("q"),
        F.hour(ts).alias("h"), F.dayofweek(ts).alias("sunday_first"), F.weekday(ts).alias("monday_first"),
        F.weekofyear(ts).alias("iso_week"), X.year_month(ts).alias("ym"),
    )


@query(
    "fn_date_arith",
    """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 7 DAY AS DATE) AS week_later,
    CAST(CAST(o_orderdate AS DATE) - INTERVAL 30 DAY AS DATE) AS month_ago,
    CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS next_month, last_day(o_orderdate) AS month_end,
    date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-02') AS age FROM orders""",
    sales=False,
)
def fn_date_arith(spark, d):
    from tillspark.plans.cleaning_queries import dated_orders

    day = X.as_date("date_of_sale")
    return dated_orders(spark, d).select(
        "o_orderkey", F.date_add(day, 7).alias("week_later"), F.date_sub(day, 30).alias("month_ago"),
        F.add_months(day, 1).alias("next_month"), F.last_day(day).alias("month_end"),
        F.datediff(F.lit("2001-08-02").cast("date"), day).alias("age"),
    )


@query(
    "fn_numeric",
    """SELECT transaction_id, product_id, abs(quantity_sold - 25) AS gap, floor(CAST(price AS DOUBLE)) AS whole_price,
    round(sqrt(CAST(total_amount AS DOUBLE)), 6) AS root, least(quantity_sold, 10) AS capped,
    coalesce(nullif(quantity_sold, 1), 0) AS filled, concat(quantity_sold, '-', store_id) AS tag FROM sales""",
)
def fn_numeric(spark, d):
    lines = sales(spark, d, "transaction_id", "product_id", "quantity_sold", "price", "total_amount", "store_id")
    q = F.col("quantity_sold")
    out = lines.select(
        "transaction_id", "product_id", F.abs(q - 25).alias("gap"), X.double(F.floor(X.double("price"))).alias("whole_price"),
        F.sqrt(X.double("total_amount")).alias("root"), F.least(q, F.lit(10)).alias("capped"),
        F.coalesce(F.nullif(q, F.lit(1)), F.lit(0)).alias("filled"), F.concat(q, F.lit("-"), "store_id").alias("tag"),
    )
    return rounded(out, "root", digits=6)


# ---- anomalies and the flat forecast ---------------------------------------------------------------------------------

ANOMALY_SQL = f"""SELECT sale_date, {D} AS daily_total, round(({D} - m) / sd, 6) AS z_score, 'Anomaly' AS anomaly_status
    FROM daily, {Z_SQL} WHERE abs(({D} - m) / sd) > 2.5"""


@query("anom_zscore", ANOMALY_SQL)
def anom_zscore(spark, d):
    return rounded(anomaly.zscore_anomalies(daily(spark, d)), "z_score", digits=6)


@query(
    "view_anomalies",
    ANOMALY_SQL,
)
def view_anomalies(spark, d):
    return rounded(anomaly.zscore_anomalies(daily(spark, d), threshold=2.5), "z_score", digits=6)


@query("join_cross_scalar", f"SELECT sale_date, round(({D} - m) / sd, 6) AS z_score FROM daily, {Z_SQL}")
def join_cross_scalar(spark, d):
    return rounded(anomaly.zscores(daily(spark, d)).select("sale_date", "z_score"), "z_score", digits=6)


@query(
    "anom_zscore_by_store",
    """WITH kd AS (SELECT store_id, d AS sale_date, sum(total_amount) AS t FROM sales GROUP BY 1, 2),
    s AS (SELECT store_id, avg(CAST(t AS DOUBLE)) AS m, stddev_pop(CAST(t AS DOUBLE)) AS sd FROM kd GROUP BY 1)
    SELECT store_id, sale_date, CAST(t AS DOUBLE) AS daily_total, round((CAST(t AS DOUBLE) - m) / sd, 6) AS z_score,
    'Anomaly' AS anomaly_status FROM kd JOIN s USING (store_id) WHERE abs((CAST(t AS DOUBLE) - m) / sd) > 3""",
)
def anom_zscore_by_store(spark, d):
    keyed = series.daily_totals(sales(spark, d, "store_id", "date_of_sale", "total_amount"), ["store_id"])
    return rounded(anomaly.zscore_anomalies(keyed, 3, ["store_id"]), "z_score", digits=6)


@query(
    "anom_iqr_sql",
    f"""WITH ranked AS (SELECT {D} AS t, row_number() OVER (ORDER BY daily_total, sale_date) AS i, count(*) OVER () AS n FROM daily),
    q AS (SELECT max(t) FILTER (i = floor(n * 0.25)) AS q1, max(t) FILTER (i = floor(n * 0.75)) AS q3 FROM ranked)
    SELECT sale_date, {D} AS daily_total,
    CASE WHEN {D} > q3 + 1.5 * (q3 - q1) THEN 'High Outlier' ELSE 'Low Outlier' END AS anomaly_status,
    q1 AS first_quartile, q3 AS third_quartile, q3 - q1 AS interquartile_range,
    q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound
    FROM daily, q WHERE {D} > q3 + 1.5 * (q3 - q1) OR {D} < q1 - 1.5 * (q3 - q1)""",
)
def anom_iqr_sql(spark, d):
    return anomaly.iqr_anomalies(daily(spark, d))


@query(
    "anom_iqr_interp",
    f"""WITH q AS (SELECT quantile_cont({D}, 0.25) AS q1, quantile_cont({D}, 0.75) AS q3 FROM daily)
    SELECT round(q1, 4) AS first_quartile, round(q3, 4) AS third_quartile, round(q3 - q1, 4) AS interquartile_range,
    round(q1 - 1.5 * (q3 - q1), 4) AS lower_bound, round(q3 + 1.5 * (q3 - q1), 4) AS upper_bound FROM q""",
)
def anom_iqr_interp(spark, d):
    out = anomaly.iqr_bounds(daily(spark, d))
    return rounded(out, *out.columns)


@query(
    "fc_naive",
    """WITH r AS (SELECT sale_date, daily_total, row_number() OVER (ORDER BY sale_date DESC) AS age FROM daily),
    m AS (SELECT max(sale_date) AS last, CAST(sum(daily_total) FILTER (age <= 7) AS DOUBLE) / 7 AS w,
      CAST(sum(daily_total) AS DOUBLE) / 30 AS mm FROM r WHERE age <= 30)
    SELECT CAST(last + to_days(CAST(g AS INTEGER)) AS DATE) AS forecast_date, w AS forecast_7day_avg, mm AS forecast_30day_avg,
    round(w * CAST(0.7 AS DOUBLE) + mm * CAST(0.3 AS DOUBLE), 6) AS weighted_forecast FROM m, generate_series(0, 13) t(g)""",
)
def fc_naive(spark, d):
    return rounded(forecast.naive_forecast(daily(spark, d), 14), "weighted_forecast", digits=6)


# ---- statistics ------------------------------------------------------------------------------------------------------


def _stat_sql(c: str) -> str:
    v = f"CAST({c} AS DOUBLE)"
    return f"""SELECT '{c}' AS metric, CAST(sum({c}) AS DOUBLE) / count({c}) AS mean, quantile_cont({v}, 0.5) AS median,
    round(stddev_samp({v}), 4) AS std_dev, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
    round(quantile_cont({v}, 0.25), 6) AS q1, round(quantile_cont({v}, 0.75), 6) AS q3,
    round(quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25), 6) AS iqr, round(skewness({v}), 5) AS skewness,
    round(kurtosis({v}), 5) AS kurtosis, count(*) - count({c}) AS missing_values,
    CAST((count(*) - count({c})) * 100 AS DOUBLE) / count(*) AS missing_pct FROM sales"""


@query("stat_summary", " UNION ALL ".join(_stat_sql(c) for c in NUMERIC_COLUMNS))
def stat_summary(spark, d):
    out = stats.numeric_summary(sales(spark, d, *NUMERIC_COLUMNS), NUMERIC_COLUMNS)
    return rounded(rounded(rounded(out, "std_dev"), "q1", "q3", "iqr", digits=6), "skewness", "kurtosis", digits=5)


@query(
    "stat_corr",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS r FROM sales"
        for a in NUMERIC_COLUMNS
        for b in NUMERIC_COLUMNS
    ),
)
def stat_corr(spark, d):
    return rounded(stats.correlations(sales(spark, d, *NUMERIC_COLUMNS), NUMERIC_COLUMNS), "r", digits=6)


SERIES_SQL = """s AS (SELECT year * 12 + month - 1 AS t, last_day(make_date(year, month, 1)) AS ds, CAST(monthly_total AS DOUBLE) AS y
    FROM monthly)"""
DECOMPOSE_SQL = f"""{SERIES_SQL},
    tr AS (SELECT a.t, a.ds, a.y, (SELECT CASE WHEN count(*) = 13 THEN
        sum(CASE WHEN abs(b.t - a.t) = 6 THEN b.y / 2 ELSE b.y END) / 12 END FROM s b WHERE abs(b.t - a.t) <= 6) AS trend FROM s a),
    slots AS (SELECT t % 12 AS slot, avg(y / trend) AS f FROM tr GROUP BY 1),
    parts AS (SELECT t, ds, y, trend, f / (SELECT avg(f) FROM slots) AS seasonal,
      y / (trend * f / (SELECT avg(f) FROM slots)) AS resid FROM tr JOIN slots ON slot = t % 12)"""


@query(
    "ts_decompose",
    f"""WITH {DECOMPOSE_SQL} SELECT ds, y, round(trend, 5) AS trend, round(seasonal, 8) AS seasonal, round(resid, 8) AS resid,
    'ok' AS status FROM parts""",
)
def ts_decompose(spark, d):
    out = series.decompose(series.month_series(monthly(spark, d))).drop("t")
    return rounded(rounded(out, "trend", digits=5), "seasonal", "resid", digits=8)


@query(
    "ts_strength",
    f"""WITH {DECOMPOSE_SQL}, v AS (SELECT 1 - var_pop(resid) / var_pop(seasonal + resid) AS s,
      1 - var_pop(resid) / var_pop(trend + resid) AS t FROM parts)
    SELECT 'ok' AS status, round(s, 6) AS seasonal_strength, round(t, 6) AS trend_strength,
    CASE WHEN s > 0.6 THEN 'strong' WHEN s > 0.3 THEN 'moderate' ELSE 'weak' END AS verdict FROM v""",
)
def ts_strength(spark, d):
    out = series.pattern_strength(series.decompose(series.month_series(monthly(spark, d))))
    return rounded(out, "seasonal_strength", "trend_strength", digits=6)


@query(
    "ts_acf",
    f"""WITH {SERIES_SQL}, c AS (SELECT t, y - (SELECT avg(y) FROM s) AS c FROM s),
    a AS (SELECT g AS lag, CASE WHEN g = 0 THEN 1.0 ELSE (SELECT sum(x.c * z.c) FROM c x JOIN c z ON x.t = z.t + g)
      / (SELECT sum(c * c) FROM c) END AS acf FROM generate_series(0, least(24, (SELECT count(*) // 2 FROM s))) k(g))
    SELECT (SELECT count(*) FROM s) AS n, CAST(p.lag AS INTEGER) AS lag, round(CAST(p.acf AS DOUBLE), 8) AS acf,
    round(CASE WHEN p.lag = 0 THEN 0 ELSE 1.96 * sqrt((1 + 2 * coalesce((SELECT sum(e.acf * e.acf) FROM a e WHERE e.lag > 0
      AND e.lag < p.lag), 0)) / (SELECT count(*) FROM s)) END, 8) AS half_width FROM a p""",
)
def ts_acf(spark, d):
    return rounded(series.autocorrelation(series.month_series(monthly(spark, d))), "acf", "half_width", digits=8)
