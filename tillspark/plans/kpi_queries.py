"""Key figures and dashboard views over the canonical sales fact."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillspark.operators import kpi, series
from tillspark.plans.registry import query, rounded
from tillspark.sources import files
from tillspark.sources.star import event_sales, order_amounts, sales

PRICE_LIMITS = (850, 1700, 2600, 5000)  # about the quintiles of the test tables' unit prices

AMOUNT = "CAST(sum(total_amount) AS DOUBLE)"
MEAN = "CAST(sum(total_amount) AS DOUBLE) / count(total_amount)"
UNITS = "CAST(sum(quantity_sold) AS BIGINT)"


@query("agg_total", f"SELECT {AMOUNT} AS total_revenue, count(transaction_id) AS total_sales FROM sales")
def agg_total(spark, d):
    return kpi.revenue_total(sales(spark, d, "transaction_id", "total_amount"))


@query(
    "agg_by_category",
    f"SELECT category, {UNITS} AS total_quantity, {AMOUNT} AS total_revenue FROM sales GROUP BY category",
)
def agg_by_category(spark, d):
    return kpi.by_category(sales(spark, d, "category", "quantity_sold", "total_amount"))


@query(
    "agg_top_products",
    f"""SELECT product_name, {UNITS} AS total_quantity, {AMOUNT} AS total_revenue FROM sales
    GROUP BY product_name ORDER BY total_quantity DESC, product_name LIMIT 10""",
)
def agg_top_products(spark, d):
    return kpi.top_products(sales(spark, d, "product_name", "quantity_sold", "total_amount"))


@query("agg_month", f"SELECT strftime(d, '%Y-%m') AS month, {AMOUNT} AS total_revenue FROM sales GROUP BY 1")
def agg_month(spark, d):
    return kpi.by_year_month(sales(spark, d, "date_of_sale", "total_amount"))


@query(
    "agg_location",
    f"SELECT location, {AMOUNT} AS total_revenue, count(transaction_id) AS total_sales FROM sales GROUP BY location",
)
def agg_location(spark, d):
    return kpi.by_location(sales(spark, d, "location", "transaction_id", "total_amount"))


@query(
    "agg_payment",
    f"""SELECT payment_method, count(transaction_id) AS transaction_count, {AMOUNT} AS total_spent
    FROM sales GROUP BY payment_method""",
)
def agg_payment(spark, d):
    return kpi.by_payment(sales(spark, d, "payment_method", "transaction_id", "total_amount"))


@query(
    "agg_stock",
    f"""SELECT stock_availability, count(transaction_id) AS transaction_count, {AMOUNT} AS total_revenue
    FROM sales GROUP BY stock_availability""",
)
def agg_stock(spark, d):
    return kpi.by_stock(sales(spark, d, "stock_availability", "transaction_id", "total_amount"))


@query(
    "agg_employee",
    f"""SELECT employee_name, {AMOUNT} AS total_sales, count(transaction_id) AS total_transactions,
    {MEAN} AS avg_transaction_value FROM sales GROUP BY employee_name""",
)
def agg_employee(spark, d):
    return kpi.by_employee(sales(spark, d, "employee_name", "transaction_id", "total_amount"))


@query(
    "agg_employee_product",
    f"""SELECT employee_name, product_name, {UNITS} AS total_quantity_sold FROM sales
    GROUP BY employee_name, product_name""",
)
def agg_employee_product(spark, d):
    return kpi.by_employee_product(sales(spark, d, "employee_name", "product_name", "quantity_sold"))


@query(
    "agg_employee_best_product",
    f"""WITH units AS (SELECT employee_name, product_name, {UNITS} AS q FROM sales GROUP BY 1, 2)
    SELECT employee_name, product_name, q AS total_quantity_sold FROM units
    QUALIFY row_number() OVER (PARTITION BY employee_name ORDER BY q DESC, product_name) = 1""",
)
def agg_employee_best_product(spark, d):
    return kpi.best_product_per_employee(sales(spark, d, "employee_name", "product_name", "quantity_sold"))


@query(
    "agg_employee_month",
    f"""SELECT employee_name, strftime(d, '%Y-%m') AS month, {AMOUNT} AS total_revenue FROM sales GROUP BY 1, 2""",
)
def agg_employee_month(spark, d):
    return kpi.by_employee_month(sales(spark, d, "employee_name", "date_of_sale", "total_amount"))


SUMMARY_COLUMNS = ("customer_name", "product_name", "quantity_sold", "total_amount", "date_of_sale")


@query(
    "agg_summary",
    f"""SELECT count(*) AS total_transactions, count(DISTINCT customer_name) AS unique_customers,
    count(DISTINCT product_name) AS unique_products, {UNITS} AS total_items_sold, {AMOUNT} AS total_revenue,
    {MEAN} AS avg_transaction_value, min(d) AS earliest_date, max(d) AS latest_date FROM sales""",
)
def agg_summary(spark, d):
    return kpi.summary(sales(spark, d, *SUMMARY_COLUMNS))


def _metric_sql(label: str, column: str) -> str:
    return f"""SELECT '{label}' AS metric, CAST(sum({column}) AS DOUBLE) / count({column}) AS mean,
    (SELECT CAST({column} AS DOUBLE) FROM sales ORDER BY {column} LIMIT 1
     OFFSET (SELECT count(*) // 2 FROM sales)) AS median,
    round(stddev_pop(CAST({column} AS DOUBLE)), 4) AS std_dev, CAST(min({column}) AS DOUBLE) AS min_value,
    CAST(max({column}) AS DOUBLE) AS max_value FROM sales"""


METRIC_SQL = " UNION ALL ".join(_metric_sql(label, column) for column, label in kpi.METRIC_LABELS.items())


@query("agg_numeric_stats", METRIC_SQL)
def agg_numeric_stats(spark, d):
    return rounded(kpi.numeric_statistics(sales(spark, d, "quantity_sold", "price", "total_amount")), "std_dev")


@query(
    "agg_missing",
    """SELECT count(*) FILTER (quantity_sold IS NULL) AS quantity_sold_nulls,
    count(*) FILTER (price IS NULL) AS price_nulls, count(*) FILTER (total_amount IS NULL) AS total_amount_nulls,
    count(*) AS total_rows,
    CAST(count(*) FILTER (quantity_sold IS NULL) * 100 AS DOUBLE) / count(*) AS quantity_sold_null_pct,
    CAST(count(*) FILTER (price IS NULL) * 100 AS DOUBLE) / count(*) AS price_null_pct,
    CAST(count(*) FILTER (total_amount IS NULL) * 100 AS DOUBLE) / count(*) AS total_amount_null_pct FROM sales""",
)
def agg_missing(spark, d):
    return kpi.missing_values(sales(spark, d, "quantity_sold", "price", "total_amount"))


def daily(spark, d):
    return series.daily_totals(order_amounts(spark, d, "date_of_sale"))


def monthly(spark, d):
    return series.monthly_totals(order_amounts(spark, d, "date_of_sale"))


@query("agg_daily", "SELECT sale_date, CAST(daily_total AS DOUBLE) AS daily_sales FROM daily")
def agg_daily(spark, d):
    return daily(spark, d).selectExpr("sale_date", "CAST(daily_total AS DOUBLE) AS daily_sales").orderBy("sale_date")


@query("agg_monthly", "SELECT year, month, CAST(monthly_total AS DOUBLE) AS monthly_sales FROM monthly")
def agg_monthly(spark, d):
    totals = monthly(spark, d).selectExpr("year", "month", "CAST(monthly_total AS DOUBLE) AS monthly_sales")
    return totals.orderBy("year", "month")


@query(
    "agg_yoy",
    """SELECT a.year, a.month, CAST(a.monthly_total AS DOUBLE) AS monthly_sales,
    CAST(b.monthly_total AS DOUBLE) AS prev_year_sales,
    CAST(a.monthly_total - b.monthly_total AS DOUBLE) AS yoy_difference,
    CAST(a.monthly_total - b.monthly_total AS DOUBLE) / nullif(CAST(b.monthly_total AS DOUBLE), 0) * 100
      AS yoy_growth_pct
    FROM monthly a LEFT JOIN monthly b ON a.year = b.year + 1 AND a.month = b.month""",
)
def agg_yoy(spark, d):
    return kpi.year_over_year(monthly(spark, d))


TEST_YEARS = range(1995, 2002)  # fixed values: the years of the order dates in the test tables


@query(
    "agg_yoy_pivot",
    "SELECT month, " + ", ".join(f"CAST(sum(monthly_total) FILTER (year = {y}) AS DOUBLE) AS y{y}" for y in TEST_YEARS) + " FROM monthly GROUP BY month",
)
def agg_yoy_pivot(spark, d):
    return kpi.year_month_table(monthly(spark, d))


@query("agg_distinct", "SELECT DISTINCT year(d) AS year FROM sales")
def agg_distinct(spark, d):
    return kpi.years_present(monthly(spark, d))


@query(
    "agg_dow_seasonality",
    """SELECT dayofweek(sale_date) + 1 AS day_of_week, dayname(sale_date) AS day_name,
    CAST(sum(daily_total) AS DOUBLE) / count(*) AS avg_daily_sales FROM daily GROUP BY 1, 2""",
)
def agg_dow_seasonality(spark, d):
    return kpi.weekday_seasonality(daily(spark, d)).selectExpr(
        "CAST(day_of_week AS BIGINT) AS day_of_week", "day_name", "avg_daily_sales"
    )


@query(
    "agg_month_seasonality",
    """SELECT month, monthname(make_date(2000, month, 1)) AS month_name,
    CAST(sum(monthly_total) AS DOUBLE) / count(*) AS avg_monthly_sales FROM monthly GROUP BY 1, 2""",
)
def agg_month_seasonality(spark, d):
    return kpi.month_seasonality(monthly(spark, d))


IMPACT_SQL = f"count(*) AS transaction_count, {AMOUNT} AS total_sales, {MEAN} AS avg_transaction_value"


@query(
    "agg_category_impact",
    f"""SELECT product_category, {IMPACT_SQL}, {UNITS} AS total_quantity,
    CAST(sum(quantity_sold) AS DOUBLE) / count(quantity_sold) AS avg_quantity,
    {AMOUNT} / CAST(sum(quantity_sold) AS DOUBLE) AS avg_price FROM sales GROUP BY product_category""",
)
def agg_category_impact(spark, d):
    return kpi.category_impact(sales(spark, d, "product_category", "quantity_sold", "total_amount"))


@query(
    "agg_dow_impact",
    f"SELECT dayofweek(d) + 1 AS day_of_week, dayname(d) AS day_name, {IMPACT_SQL} FROM sales GROUP BY 1, 2",
)
def agg_dow_impact(spark, d):
    return kpi.weekday_impact(sales(spark, d, "date_of_sale", "total_amount"))


@query(
    "agg_month_impact",
    f"SELECT month(d) AS month, monthname(d) AS month_name, {IMPACT_SQL} FROM sales GROUP BY 1, 2",
)
def agg_month_impact(spark, d):
    return kpi.month_impact(sales(spark, d, "date_of_sale", "total_amount"))


@query("agg_store", f"SELECT store_id, {IMPACT_SQL}, {UNITS} AS total_quantity FROM sales GROUP BY store_id")
def agg_store(spark, d):
    return kpi.store_performance(sales(spark, d, "store_id", "quantity_sold", "total_amount"))


@query("agg_payment_impact", f"SELECT payment_method, {IMPACT_SQL} FROM sales GROUP BY payment_method")
def agg_payment_impact(spark, d):
    return kpi.payment_impact(sales(spark, d, "payment_method", "total_amount"))


PRICE_CASE_SQL = """CASE WHEN price < 850 THEN 'Under $850' WHEN price >= 850 AND price < 1700 THEN '$850-$1700'
    WHEN price >= 1700 AND price < 2600 THEN '$1700-$2600' WHEN price >= 2600 AND price < 5000 THEN '$2600-$5000'
    ELSE 'Over $5000' END"""


@query(
    "agg_price_range",
    f"""SELECT {PRICE_CASE_SQL} AS price_range, count(*) AS transaction_count, {UNITS} AS total_quantity,
    {AMOUNT} AS total_sales, {MEAN} AS avg_transaction_value FROM sales GROUP BY 1""",
)
def agg_price_range(spark, d):
    return kpi.price_ranges(sales(spark, d, "price", "quantity_sold", "total_amount"), PRICE_LIMITS)


# ---- dashboard views -------------------------------------------------------------------------------------------------

ACTIVITY_SQL = f"""count(*) AS transaction_count, {UNITS} AS total_items_sold, {AMOUNT} AS total_sales,
    {MEAN} AS avg_transaction_value"""
UNIQUE_SQL = "count(DISTINCT customer_name) AS unique_customers"
MEAN_PRICE = "CAST(sum(price) AS DOUBLE) / count(price)"
BASKET = ("customer_name", "quantity_sold", "total_amount")


@query("view_daily_overview", f"SELECT d AS sale_date, {ACTIVITY_SQL}, {UNIQUE_SQL} FROM sales GROUP BY d")
def view_daily_overview(spark, d):
    return kpi.daily_overview(sales(spark, d, "date_of_sale", *BASKET))


@query(
    "view_monthly_trends",
    f"SELECT year(d) AS year, month(d) AS month, {ACTIVITY_SQL}, {UNIQUE_SQL} FROM sales GROUP BY 1, 2",
)
def view_monthly_trends(spark, d):
    return kpi.monthly_trends(sales(spark, d, "date_of_sale", *BASKET))


@query(
    "view_category",
    f"SELECT product_category, {ACTIVITY_SQL}, {UNIQUE_SQL}, {MEAN_PRICE} AS avg_price FROM sales GROUP BY 1",
)
def view_category(spark, d):
    return kpi.category_performance(sales(spark, d, "product_category", "price", *BASKET))


PURCHASES_SQL = f"""count(*) AS transaction_count, {UNITS} AS total_items_purchased, {AMOUNT} AS total_spend,
    {MEAN} AS avg_transaction_value"""


@query(
    "view_customer_patterns",
    f"""SELECT customer_name, {PURCHASES_SQL}, min(d) AS first_purchase_date, max(d) AS last_purchase_date,
    date_diff('day', min(d), max(d)) AS customer_lifespan_days FROM sales GROUP BY customer_name""",
)
def view_customer_patterns(spark, d):
    return kpi.customer_patterns(sales(spark, d, "date_of_sale", *BASKET))


@query(
    "view_store",
    f"""SELECT store_id, {ACTIVITY_SQL}, {UNIQUE_SQL},
    {AMOUNT} / count(DISTINCT customer_name) AS revenue_per_customer FROM sales GROUP BY store_id""",
)
def view_store(spark, d):
    return kpi.store_overview(sales(spark, d, "store_id", *BASKET))


@query(
    "view_dow",
    f"SELECT dayofweek(d) + 1 AS day_of_week, dayname(d) AS day_name, {ACTIVITY_SQL} FROM sales GROUP BY 1, 2",
)
def view_dow(spark, d):
    return kpi.weekday_overview(sales(spark, d, "date_of_sale", "quantity_sold", "total_amount"))


@query(
    "view_hour",
    """SELECT hour(ts) AS hour_of_day, count(*) AS transaction_count, count(*) AS total_items_sold,
    CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total_sales,
    CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) / count(value) AS avg_transaction_value
    FROM events GROUP BY 1""",
    sales=False,
)
def view_hour(spark, d):
    return kpi.hourly_overview(event_sales(spark, d))


@query(
    "view_top_products",
    f"""SELECT product_name, product_category, count(*) AS transaction_count, {UNITS} AS total_quantity_sold,
    {AMOUNT} AS total_sales, {MEAN_PRICE} AS avg_price FROM sales GROUP BY 1, 2""",
)
def view_top_products(spark, d):
    columns = ("product_name", "product_category", "quantity_sold", "total_amount", "price")
    return kpi.product_ranking(sales(spark, d, *columns))


@query(
    "view_top_customers",
    f"SELECT customer_name, {PURCHASES_SQL}, max(d) AS last_purchase_date FROM sales GROUP BY customer_name",
)
def view_top_customers(spark, d):
    return kpi.customer_ranking(sales(spark, d, "date_of_sale", *BASKET))


# ---- windows, orders and sets over key figures -----------------------------------------------------------------------


@query(
    "win_rank",
    f"""SELECT employee_name, {AMOUNT} AS total_revenue, rank() OVER (ORDER BY sum(total_amount) DESC)
    AS performance_rank FROM sales GROUP BY employee_name""",
)
def win_rank(spark, d):
    return kpi.employee_ranking(sales(spark, d, "employee_name", "total_amount"))


@query(
    "agg_distinct_sketch",
    """SELECT year(d) AS year, quarter(d) AS quarter, count(*) AS lines, CAST(sum(total_amount) AS DOUBLE) AS total_sales,
    count(DISTINCT customer_name) AS unique_customers, true AS near FROM sales GROUP BY 1, 2""",
)
def agg_distinct_sketch(spark, d):
    """Customers of each quarter out of one table of daily sketches, held against the exact count: within four standard errors."""
    lines = sales(spark, d, "customer_name", "date_of_sale", "total_amount")
    table = files.write_table(kpi.daily_sketches(lines), name="daily-sketches")
    by = [F.year("sale_date").alias("year"), F.quarter("sale_date").alias("quarter")]
    exact = lines.groupBy(F.year("date_of_sale").alias("year"), F.quarter("date_of_sale").alias("quarter")).agg(F.count_distinct("customer_name").alias("unique_customers"))
    told = kpi.united(table, by).join(exact, ["year", "quarter"])
    bound = F.greatest(4 * 0.01625 * F.col("unique_customers"), F.lit(1.0))
    return told.select("year", "quarter", "lines", "total_sales", "unique_customers", (F.abs(F.col("about_distinct") - F.col("unique_customers")) <= bound).alias("near"))
