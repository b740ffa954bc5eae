"""Reading, parsing, coercing, imputing, profiling, filtering and splitting."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tillspark.functions import exprs as X
from tillspark.operators import anomaly, clean, kpi, segment, series
from tillspark.plans.kpi_queries import PRICE_CASE_SQL, PRICE_LIMITS, daily, monthly
from tillspark.plans.registry import query, rounded
from tillspark.schemas import CSV_HEADERS, ERP_SALES, NUMERIC_COLUMNS, SALES_TRANSACTIONS, conform
from tillspark.session import materialise, scratch_path
from tillspark.sources import files, star
from tillspark.sources.star import sales

# Text columns with gaps and words among the numbers, derived from the sales lines.
DIRTY_SQL = """dirty AS (SELECT transaction_id, product_id,
    CASE WHEN return_flag = 'R' THEN 'n/a' ELSE CAST(quantity_sold AS VARCHAR) END AS quantity_sold,
    CASE WHEN stock_availability = 'O' AND quantity_sold < 5 THEN '' ELSE CAST(price AS VARCHAR) END AS price,
    CASE WHEN return_flag = 'N' AND quantity_sold > 45 THEN NULL ELSE CAST(total_amount AS VARCHAR) END AS total_amount
    FROM sales)"""
NUMBERS_SQL = """numbers AS (SELECT transaction_id, product_id, try_cast(quantity_sold AS DOUBLE) AS quantity_sold,
    try_cast(price AS DOUBLE) AS price, try_cast(total_amount AS DOUBLE) AS total_amount FROM dirty)"""


def dirty(spark, d):
    lines = sales(spark, d, "transaction_id", "product_id", *NUMERIC_COLUMNS, "return_flag", "stock_availability")
    returned, open_line, units = F.col("return_flag"), F.col("stock_availability") == "O", F.col("quantity_sold")
    return lines.select(
        "transaction_id",
        "product_id",
        F.when(returned == "R", "n/a").otherwise(units.cast("string")).alias("quantity_sold"),
        F.when(open_line & (units < 5), "").otherwise(F.col("price").cast("string")).alias("price"),
        F.when((returned == "N") & (units > 45), None).otherwise(F.col("total_amount").cast("string")).alias("total_amount"),
    )


def dated_orders(spark, d):
    return star.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("date_of_sale"))


ERP_COLUMNS = tuple(CSV_HEADERS.values())
ERP_SQL = ", ".join("d AS date_of_sale" if c == "date_of_sale" else c for c in ERP_COLUMNS)


ERP_TYPED = "WITH erp AS (SELECT CAST(transaction_id AS INTEGER) AS transaction_id, customer_name, product_name, category, quantity_sold, " \
    "CAST(price AS DECIMAL(10,2)) AS price, CAST(total_amount AS DECIMAL(10,2)) AS total_amount, payment_method, location, " \
    "d AS date_of_sale, stock_availability, employee_name, erp_module FROM sales)"


def erp(spark, d):
    """The sales table in its declared types."""
    return conform(sales(spark, d, *ERP_SALES.names), ERP_SALES)


@query("src_table_erp", f"{ERP_TYPED} SELECT * FROM erp")
def src_table_erp(spark, d):
    return erp(spark, d)


@query(
    "src_table_month",
    f"""{ERP_TYPED} SELECT date_of_sale, category, count(*) AS lines, CAST(sum(total_amount) AS DOUBLE) AS total_sales FROM erp
    WHERE date_of_sale BETWEEN (SELECT max(date_of_sale) FROM erp) - INTERVAL 29 DAY AND (SELECT max(date_of_sale) FROM erp) GROUP BY 1, 2""",
)
def src_table_month(spark, d):
    """The typed table in month folders; of the last thirty days one or two are read."""
    path = scratch_path(spark, "erp-sales")
    files.write_sales(erp(spark, d), path)
    last = files.last_month(spark, path).agg(F.max("date_of_sale")).first()[0]
    if last is None:
        return kpi.group(files.read_sales(spark, path), ["date_of_sale", "category"], lines=X.rows(), total_sales=X.total("total_amount"))
    recent = files.read_sales(spark, path, last - dt.timedelta(days=29), last)
    return kpi.group(recent, ["date_of_sale", "category"], lines=X.rows(), total_sales=X.total("total_amount"))


@query(
    "src_table_star",
    """SELECT CAST(transaction_id AS VARCHAR) AS transaction_id, customer_name, employee_name, d AS date_of_sale,
    CAST(product_id AS VARCHAR) AS product_id, product_name, product_category, quantity_sold,
    CAST(price AS DECIMAL(10,2)) AS price, CAST(total_amount AS DECIMAL(10,2)) AS total_amount,
    CAST(store_id AS VARCHAR) AS store_id, payment_method FROM sales""",
)
def src_table_star(spark, d):
    """The transaction table in its declared types."""
    lines = conform(sales(spark, d, *SALES_TRANSACTIONS.names), SALES_TRANSACTIONS)
    return lines.withColumn("date_of_sale", X.as_date("date_of_sale"))


@query("src_csv", f"SELECT {ERP_SQL} FROM sales")
def src_csv(spark, d):
    """The sales table written as a CSV export with readable headers, and read back."""
    path = files.write_csv(sales(spark, d, *ERP_COLUMNS))
    return files.read_csv(spark, path).select(*(F.col(c) for c in ERP_COLUMNS))


PROFILE_KEY = ("transaction_id", "product_name", "quantity_sold", "total_amount", "employee_name")


@query(
    "src_profile",
    f"{ERP_TYPED}, drawn AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', {', '.join(PROFILE_KEY)}))) AS k FROM erp) WHERE k <= 3) "
    + " UNION ALL ".join(
        f"""SELECT '{f.name}' AS column_name, '{f.dataType.simpleString()}' AS data_type, count(*) AS row_count,
        count(*) FILTER ({f.name} IS NULL) AS null_count, count(DISTINCT {f.name}) AS distinct_count,
        (SELECT string_agg(coalesce(CAST({f.name} AS VARCHAR), 'null'), ' | ' ORDER BY k) FROM drawn) AS samples FROM erp"""
        for f in ERP_SALES
    ),
)
def src_profile(spark, d):
    return clean.profile(erp(spark, d), sample_by=PROFILE_KEY)


@query(
    "src_profile_sketch",
    f"{ERP_TYPED} " + " UNION ALL ".join(
        f"SELECT '{f.name}' AS column_name, count(*) AS row_count, count(*) FILTER ({f.name} IS NULL) AS null_count, true AS near FROM erp" for f in ERP_SALES
    ),
)
def src_profile_sketch(spark, d):
    """Distinct values by sketch, held against the exact ones: within a fifth of them (four standard errors)."""
    exact = clean.profile(erp(spark, d), samples=1).select("column_name", F.col("distinct_count").alias("exact"))
    told = clean.profile(erp(spark, d), approximate=True, samples=1).join(exact, "column_name")
    return told.select("column_name", "row_count", "null_count", (F.abs(F.col("distinct_count") - F.col("exact")) <= 0.2 * F.col("exact")).alias("near"))


@query("src_records", "SELECT sale_date AS date, CAST(daily_total AS DOUBLE) AS sales FROM daily")
def src_records(spark, d):
    """Daily totals handed over as JSON records and parsed as a scoring request."""
    records = daily(spark, d).select(
        F.to_json(F.struct(F.col("sale_date").cast("string").alias("date"), X.double("daily_total").alias("sales"))).alias("record")
    )
    return files.parse_records(records, "record").withColumn("date", F.to_date("date"))


@query("prj_to_datetime", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date_of_sale FROM orders", sales=False)
def prj_to_datetime(spark, d):
    text = F.date_format("date_of_sale", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    parsed = clean.parse_timestamps(dated_orders(spark, d).withColumn("date_of_sale", text), "date_of_sale")
    return parsed.withColumn("date_of_sale", X.as_date("date_of_sale"))


@query(
    "prj_calendar_features",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date_of_sale, year(o_orderdate) AS year, month(o_orderdate) AS month,
    day(o_orderdate) AS day, isodow(o_orderdate) - 1 AS day_of_week, quarter(o_orderdate) AS quarter,
    weekofyear(o_orderdate) AS week_of_year FROM orders""",
    sales=False,
)
def prj_calendar_features(spark, d):
    return clean.calendar_features(dated_orders(spark, d)).withColumn("date_of_sale", X.as_date("date_of_sale"))


@query("prj_to_numeric", f"WITH {DIRTY_SQL}, {NUMBERS_SQL} SELECT * FROM numbers")
def prj_to_numeric(spark, d):
    return clean.to_numeric(dirty(spark, d))


@query(
    "prj_impute_median",
    f"""WITH {DIRTY_SQL}, {NUMBERS_SQL} SELECT transaction_id, product_id,
    coalesce(quantity_sold, (SELECT quantile_cont(quantity_sold, 0.5) FROM numbers)) AS quantity_sold,
    coalesce(price, (SELECT quantile_cont(price, 0.5) FROM numbers)) AS price,
    coalesce(total_amount, (SELECT quantile_cont(total_amount, 0.5) FROM numbers)) AS total_amount FROM numbers""",
)
def prj_impute_median(spark, d):
    return clean.impute_median(clean.to_numeric(dirty(spark, d)))


@query(
    "flt_is_null",
    f"""WITH {DIRTY_SQL}, {NUMBERS_SQL} SELECT count(*) FILTER (quantity_sold IS NULL) AS quantity_sold_nulls,
    count(*) FILTER (price IS NULL) AS price_nulls, count(*) FILTER (total_amount IS NULL) AS total_amount_nulls,
    count(*) AS total_rows,
    CAST(count(*) FILTER (quantity_sold IS NULL) * 100 AS DOUBLE) / count(*) AS quantity_sold_null_pct,
    CAST(count(*) FILTER (price IS NULL) * 100 AS DOUBLE) / count(*) AS price_null_pct,
    CAST(count(*) FILTER (total_amount IS NULL) * 100 AS DOUBLE) / count(*) AS total_amount_null_pct FROM numbers""",
)
def flt_is_null(spark, d):
    return kpi.missing_values(clean.to_numeric(dirty(spark, d)))


@query("prj_price_bucket", f"SELECT transaction_id, product_id, price, {PRICE_CASE_SQL} AS price_range FROM sales")
def prj_price_bucket(spark, d):
    return sales(spark, d, "transaction_id", "product_id", "price").withColumn(
        "price_range", X.price_bucket("price", PRICE_LIMITS)
    )


@query("prj_dow_name", "SELECT o_orderkey, dayname(o_orderdate) AS day_name FROM orders", sales=False)
def prj_dow_name(spark, d):
    return dated_orders(spark, d).select("o_orderkey", X.weekday_name("date_of_sale").alias("day_name"))


@query("prj_month_name", "SELECT o_orderkey, monthname(o_orderdate) AS month_name FROM orders", sales=False)
def prj_month_name(spark, d):
    return dated_orders(spark, d).select("o_orderkey", X.month_name("date_of_sale").alias("month_name"))


@query(
    "prj_safe_ratio",
    """SELECT transaction_id, CAST(sum(total_amount) AS DOUBLE)
      / nullif(CAST(sum(CASE WHEN return_flag = 'R' THEN quantity_sold ELSE 0 END) AS DOUBLE), 0) AS amount_per_returned_unit
    FROM sales GROUP BY transaction_id""",
)
def prj_safe_ratio(spark, d):
    returned = F.sum(F.when(F.col("return_flag") == "R", F.col("quantity_sold")).otherwise(0))
    lines = sales(spark, d, "transaction_id", "total_amount", "return_flag", "quantity_sold")
    return lines.groupBy("transaction_id").agg(
        X.ratio(F.sum("total_amount"), returned).alias("amount_per_returned_unit")
    )


@query(
    "prj_diff",
    """WITH first AS (SELECT year, month, monthly_total - lag(monthly_total) OVER (ORDER BY year, month) AS diff FROM monthly),
    second AS (SELECT year, month, diff - lag(diff) OVER (ORDER BY year, month) AS diff FROM first)
    SELECT 1 AS times, year, month, CAST(diff AS DOUBLE) AS diff FROM first WHERE diff IS NOT NULL
    UNION ALL SELECT 2, year, month, CAST(diff AS DOUBLE) FROM second WHERE diff IS NOT NULL""",
)
def prj_diff(spark, d):
    months = monthly(spark, d).withColumn("t", F.col("year") * 12 + F.col("month"))
    both = [
        series.difference(months, "t", "monthly_total", n).select(
            F.lit(n).alias("times"), "year", "month", X.double("diff").alias("diff")
        )
        for n in (1, 2)
    ]
    return both[0].unionByName(both[1])


@query("prj_drop", "SELECT category, location, quantity_sold, price, total_amount FROM sales")
def prj_drop(spark, d):
    columns = ("transaction_id", "customer_name", "employee_name", "date_of_sale", "category", "location", *NUMERIC_COLUMNS)
    lines = sales(spark, d, *columns)
    return clean.drop_present(lines, "transaction_id", "customer_name", "employee_name", "date_of_sale", "not_there")


@query("prj_rename", 'SELECT transaction_id AS "Transaction ID", category AS "Category", total_amount AS "Total Amount" FROM sales')
def prj_rename(spark, d):
    back = {column: header for header, column in CSV_HEADERS.items()}
    return clean.rename(sales(spark, d, "transaction_id", "category", "total_amount"), back)


@query(
    "prj_flatten",
    """SELECT location, CAST(sum(total_amount) AS DOUBLE) AS total_amount_sum,
    CAST(sum(total_amount) AS DOUBLE) / count(total_amount) AS total_amount_mean, count(total_amount) AS total_amount_count,
    CAST(sum(quantity_sold) AS DOUBLE) AS quantity_sold_sum, CAST(max(price) AS DOUBLE) AS price_max FROM sales GROUP BY location""",
)
def prj_flatten(spark, d):
    lines = sales(spark, d, "location", *NUMERIC_COLUMNS)
    wanted = {"total_amount": ["sum", "mean", "count"], "quantity_sold": ["sum"], "price": ["max"]}
    return clean.flat_aggregates(lines, "location", wanted)


@query("prj_literal_tag", "SELECT 'Daily Sales' AS metric, sale_date, CAST(daily_total AS DOUBLE) AS value FROM daily")
def prj_literal_tag(spark, d):
    return daily(spark, d).select(F.lit("Daily Sales").alias("metric"), "sale_date", X.double("daily_total").alias("value"))


@query(
    "prj_map_values",
    """WITH s AS (SELECT avg(CAST(daily_total AS DOUBLE)) AS m, stddev_pop(CAST(daily_total AS DOUBLE)) AS sd FROM daily),
    f AS (SELECT CASE WHEN abs((CAST(daily_total AS DOUBLE) - m) / sd) > 2.5 THEN -1 ELSE 1 END AS flag FROM daily, s)
    SELECT CASE flag WHEN 1 THEN 0 WHEN -1 THEN 1 END AS anomaly, count(*) AS days FROM f GROUP BY 1""",
)
def prj_map_values(spark, d):
    flag = F.when(F.abs("z_score") > 2.5, -1).otherwise(1)
    flagged = anomaly.zscores(daily(spark, d)).withColumn("flag", flag)
    return flagged.groupBy(X.recode("flag", {1: 0, -1: 1}).alias("anomaly")).agg(X.rows().alias("days"))


# ---- filters ---------------------------------------------------------------------------------------------------------


@query(
    "flt_between_bounds",
    """SELECT CAST(g AS DATE) AS date_id FROM generate_series(
      (SELECT CAST(min(d) AS TIMESTAMP) - INTERVAL 400 DAY FROM sales), (SELECT CAST(max(d) AS TIMESTAMP) + INTERVAL 400 DAY FROM sales),
      INTERVAL 1 DAY) t(g)
    WHERE CAST(g AS DATE) BETWEEN (SELECT min(d) FROM sales) AND (SELECT max(d) FROM sales)""",
)
def flt_between_bounds(spark, d):
    """A calendar that reaches over a year beyond the sales on both sides, cut to their bounds."""
    dates = sales(spark, d, "date_of_sale")
    first, last = series.date_bounds(dates, 400)
    days = series.date_dimension(spark, first, last).select("date_id")
    return clean.between_bounds(days, F.col("date_id"), dates, X.as_date("date_of_sale"))


@query(
    "flt_between_interval",
    """SELECT sale_date, CAST(daily_total AS DOUBLE) AS daily_sales FROM daily
    WHERE sale_date BETWEEN (SELECT max(sale_date) FROM daily) - INTERVAL 29 DAY AND (SELECT max(sale_date) FROM daily)""",
)
def flt_between_interval(spark, d):
    """The last day is read first, so that the dates of the second read are literals that reach the scan."""
    _, last = series.date_bounds(sales(spark, d, "date_of_sale"))
    lines = sales(spark, d, "date_of_sale", "total_amount")
    start = F.lit(last).cast("date").cast("timestamp_ntz") - F.expr("INTERVAL 29 DAYS")
    stop = F.lit(last).cast("date").cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
    recent = lines.filter((F.col("date_of_sale") >= start) & (F.col("date_of_sale") < stop))
    return series.daily_totals(recent).select("sale_date", X.double("daily_total").alias("daily_sales"))


@query(
    "flt_threshold",
    """WITH s AS (SELECT avg(CAST(daily_total AS DOUBLE)) AS m, stddev_pop(CAST(daily_total AS DOUBLE)) AS sd FROM daily)
    SELECT sale_date, round((CAST(daily_total AS DOUBLE) - m) / sd, 6) AS z_score FROM daily, s
    WHERE abs((CAST(daily_total AS DOUBLE) - m) / sd) > 1.5""",
)
def flt_threshold(spark, d):
    far = anomaly.zscores(daily(spark, d)).filter(F.abs("z_score") > 1.5)
    return rounded(far.select("sale_date", "z_score"), "z_score", digits=6)


@query(
    "flt_having",
    "SELECT customer_name, product_name, count(*) AS lines FROM sales GROUP BY 1, 2 HAVING count(*) > 3",
)
def flt_having(spark, d):
    counted = kpi.group(sales(spark, d, "customer_name", "product_name"), ["customer_name", "product_name"], lines=X.rows())
    return counted.filter(F.col("lines") > 3)


@query(
    "flt_in_list",
    "SELECT sale_date, CAST(daily_total AS DOUBLE) AS daily_sales FROM daily WHERE dayofweek(sale_date) + 1 IN (1, 7)",
)
def flt_in_list(spark, d):
    lines = sales(spark, d, "date_of_sale", "total_amount").filter(F.dayofweek("date_of_sale").isin(1, 7))
    return series.daily_totals(lines).select("sale_date", X.double("daily_total").alias("daily_sales"))


@query("flt_eq", "SELECT month, CAST(monthly_total AS DOUBLE) AS monthly_sales FROM monthly WHERE year = 1998")
def flt_eq(spark, d):
    low, high = F.lit("1998-01-01").cast("timestamp_ntz"), F.lit("1999-01-01").cast("timestamp_ntz")
    year = sales(spark, d, "date_of_sale", "total_amount").filter((F.col("date_of_sale") >= low) & (F.col("date_of_sale") < high))
    return series.monthly_totals(year).select("month", X.double("monthly_total").alias("monthly_sales"))


@query(
    "flt_dropna",
    """WITH r AS (SELECT year, month, avg(CAST(monthly_total AS DOUBLE)) OVER w AS m, count(*) OVER w AS n FROM monthly
      WINDOW w AS (ORDER BY year, month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
    SELECT year, month, round(m, 4) AS rolling_mean_12 FROM r WHERE n = 12""",
)
def flt_dropna(spark, d):
    months = monthly(spark, d).withColumn("t", F.col("year") * 12 + F.col("month"))
    out = series.rolling(months, "t", "monthly_total", 12).dropna(subset=["rolling_mean_12"])
    return rounded(out.select("year", "month", "rolling_mean_12"), "rolling_mean_12")


@query(
    "flt_seq_lt",
    """SELECT seq, CAST((SELECT max(d) FROM sales) + to_days(CAST(seq AS INTEGER)) AS DATE) AS forecast_date
    FROM generate_series(0, 29) t(seq) WHERE seq < 12""",
)
def flt_seq_lt(spark, d):
    last = sales(spark, d, "date_of_sale").agg(F.max(X.as_date("date_of_sale")).alias("last"))
    steps = last.select("last", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("step"))
    return steps.select(F.col("step").cast("bigint").alias("seq"), F.date_add("last", F.col("step")).alias("forecast_date"))


# ---- splits ----------------------------------------------------------------------------------------------------------


@query("sample_split_random")
def sample_split_random(spark, d):
    lines = sales(spark, d, "transaction_id", "product_id", "quantity_sold", "total_amount", "date_of_sale")
    return kpi.group(clean.split_random(lines), ["part"], rows=X.rows(), total_sales=X.total("total_amount"))


@query(
    "sample_split_time",
    """WITH n AS (SELECT *, row_number() OVER (ORDER BY year, month) AS i, count(*) OVER () AS c FROM monthly)
    SELECT last_day(make_date(year, month, 1)) AS ds, CAST(monthly_total AS DOUBLE) AS y,
    CASE WHEN i <= floor(c * 0.8) THEN 'train' ELSE 'test' END AS part FROM n""",
)
def sample_split_time(spark, d):
    return series.split_by_time(series.month_series(monthly(spark, d))).select("ds", "y", "part")


@query(
    "join_align_index",
    """SELECT customer_name, CAST(sum(total_amount) AS DOUBLE) AS total_spend,
    CAST(sum(total_amount) AS DOUBLE) > (SELECT CAST(sum(total_amount) AS DOUBLE) / count(DISTINCT customer_name) FROM sales)
      AS above_average FROM sales GROUP BY customer_name""",
)
def join_align_index(spark, d):
    """Labels computed apart from the customer table and joined back by the customer key, not by position."""
    features = segment.customer_features(sales(spark, d, "customer_name", *NUMERIC_COLUMNS))
    spend = materialise(features.select("customer_name", "total_spend"))
    average = spend.agg(F.avg("total_spend")).scalar()
    labels = spend.select("customer_name", (F.col("total_spend") > average).alias("above_average"))
    return spend.join(labels, "customer_name")
