"""Key figures: one grouped aggregation each, combined map-side before its only shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillspark.functions import exprs as X
from tillspark.session import materialise
from tillspark.operators import ordering

TS = "date_of_sale"
AMOUNT = "total_amount"
UNITS = "quantity_sold"


def group(sales: DataFrame, by: Sequence[Column | str], **measures: Column) -> DataFrame:
    return sales.groupBy(*by).agg(*(m.alias(name) for name, m in measures.items()))


# ---- totals and breakdowns -------------------------------------------------------------------------------------------


def revenue_total(sales: DataFrame) -> DataFrame:
    return group(sales, [], total_revenue=X.total(AMOUNT), total_sales=F.count("transaction_id"))


def by_category(sales: DataFrame) -> DataFrame:
    out = group(sales, ["category"], total_quantity=F.sum(UNITS), total_revenue=X.total(AMOUNT))
    return out.orderBy(F.desc("total_revenue"), "category")


def top_products(sales: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` products with most units; equal quantities are ordered by name."""
    out = group(sales, ["product_name"], total_quantity=F.sum(UNITS), total_revenue=X.total(AMOUNT))
    return out.orderBy(F.desc("total_quantity"), "product_name").limit(n)


def by_year_month(sales: DataFrame) -> DataFrame:
    return group(sales, [X.year_month(TS).alias("month")], total_revenue=X.total(AMOUNT)).orderBy("month")


def by_location(sales: DataFrame) -> DataFrame:
    out = group(sales, ["location"], total_revenue=X.total(AMOUNT), total_sales=F.count("transaction_id"))
    return out.orderBy(F.desc("total_revenue"), "location")


def by_payment(sales: DataFrame) -> DataFrame:
    out = group(sales, ["payment_method"], transaction_count=F.count("transaction_id"), total_spent=X.total(AMOUNT))
    return out.orderBy(F.desc("total_spent"), "payment_method")


def by_stock(sales: DataFrame) -> DataFrame:
    return group(
        sales, ["stock_availability"], transaction_count=F.count("transaction_id"), total_revenue=X.total(AMOUNT)
    )


def by_employee(sales: DataFrame) -> DataFrame:
    out = group(
        sales,
        ["employee_name"],
        total_sales=X.total(AMOUNT),
        total_transactions=F.count("transaction_id"),
        avg_transaction_value=X.mean(AMOUNT),
    )
    return out.orderBy(F.desc("total_sales"), "employee_name")


def by_employee_product(sales: DataFrame) -> DataFrame:
    out = group(sales, ["employee_name", "product_name"], total_quantity_sold=F.sum(UNITS))
    return out.orderBy("employee_name", F.desc("total_quantity_sold"), "product_name")


def best_product_per_employee(sales: DataFrame) -> DataFrame:
    """Top seller of each employee (an addition to the full listing), as an aggregate rather than a per-employee sort."""
    units = group(sales, ["employee_name", "product_name"], q=F.sum(UNITS))
    best = F.min_by(F.struct("product_name", "q"), F.struct(-F.col("q"), F.col("product_name")))
    return (
        units.groupBy("employee_name")
        .agg(best.alias("best"))
        .select("employee_name", "best.product_name", F.col("best.q").alias("total_quantity_sold"))
    )


def by_employee_month(sales: DataFrame) -> DataFrame:
    out = group(sales, ["employee_name", X.year_month(TS).alias("month")], total_revenue=X.total(AMOUNT))
    return out.orderBy("employee_name", "month")


def employee_ranking(sales: DataFrame) -> DataFrame:
    """Competition rank of employees by revenue, without sending all employees through one task."""
    revenue = sales.groupBy("employee_name").agg(F.sum(AMOUNT).alias("revenue"))
    ranked = ordering.rank(revenue, F.desc("revenue"), "revenue", out="performance_rank")
    return ranked.select("employee_name", X.double("revenue").alias("total_revenue"), "performance_rank")


# ---- summaries -------------------------------------------------------------------------------------------------------


def summary(sales: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return group(
        sales,
        [],
        total_transactions=X.rows(),
        unique_customers=distinct("customer_name"),
        unique_products=distinct("product_name"),
        total_items_sold=F.sum(UNITS),
        total_revenue=X.total(AMOUNT),
        avg_transaction_value=X.mean(AMOUNT),
        earliest_date=F.min(X.as_date(TS)),
        latest_date=F.max(X.as_date(TS)),
    )


# Label of each summarised metric.
METRIC_LABELS = {"quantity_sold": "Quantity Sold", "price": "Price", "total_amount": "Total Amount"}


def numeric_statistics(sales: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """Mean, upper median, population spread and range of several metrics from one scan of the table."""
    labels = labels or METRIC_LABELS
    counts = ordering.value_counts(sales, list(labels))
    median = ordering.order_statistics(counts, lambda n: {"median": n // 2 + 1})
    return ordering.moments(counts).join(median.select("metric", "median"), "metric").select(
        X.recode("metric", labels).alias("metric"),
        "mean",
        X.double("median").alias("median"),
        F.sqrt(X.ratio("m2", "rows")).alias("std_dev"),
        F.col("min").alias("min_value"),
        F.col("max").alias("max_value"),
    )


def missing_values(sales: DataFrame, columns: Sequence[str] = ("quantity_sold", "price", "total_amount")) -> DataFrame:
    counts = {f"{c}_nulls": F.count_if(F.col(c).isNull()) for c in columns}
    shares = {f"{c}_null_pct": X.ratio(F.count_if(F.col(c).isNull()) * 100, X.rows()) for c in columns}
    return group(sales, [], **counts, total_rows=X.rows(), **shares)


# ---- impact and seasonality ------------------------------------------------------------------------------------------


def _impact() -> dict[str, Column]:
    return {
        "transaction_count": X.rows(),
        "total_sales": X.total(AMOUNT),
        "avg_transaction_value": X.mean(AMOUNT),
    }


def category_impact(sales: DataFrame) -> DataFrame:
    out = group(
        sales, ["product_category"], **_impact(),
        total_quantity=F.sum(UNITS), avg_quantity=X.mean(UNITS), avg_price=X.ratio(F.sum(AMOUNT), F.sum(UNITS)),
    )
    return out.orderBy(F.desc("total_sales"), "product_category")


def weekday_impact(sales: DataFrame) -> DataFrame:
    by = [F.dayofweek(TS).alias("day_of_week"), X.weekday_name(TS).alias("day_name")]
    return group(sales, by, **_impact()).orderBy(F.desc("total_sales"), "day_of_week")


def month_impact(sales: DataFrame) -> DataFrame:
    by = [F.month(TS).alias("month"), X.month_name(TS).alias("month_name")]
    return group(sales, by, **_impact()).orderBy("month")


def store_performance(sales: DataFrame) -> DataFrame:
    return group(sales, ["store_id"], **_impact(), total_quantity=F.sum(UNITS)).orderBy(
        F.desc("total_sales"), "store_id"
    )


def payment_impact(sales: DataFrame) -> DataFrame:
    return group(sales, ["payment_method"], **_impact()).orderBy(F.desc("total_sales"), "payment_method")


def price_ranges(sales: DataFrame, limits: Sequence[int] = X.PRICE_LIMITS) -> DataFrame:
    """Sales by price range, listed from the cheapest range to the dearest."""
    by = [X.bucket_position("price", limits).alias("position"), X.price_bucket("price", limits).alias("price_range")]
    out = group(
        sales, by, transaction_count=X.rows(), total_quantity=F.sum(UNITS),
        total_sales=X.total(AMOUNT), avg_transaction_value=X.mean(AMOUNT),
    )
    return out.orderBy("position").drop("position")


def weekday_seasonality(daily: DataFrame) -> DataFrame:
    """Average day total per weekday; input is one row per day."""
    by = [F.dayofweek("sale_date").alias("day_of_week"), X.weekday_name("sale_date").alias("day_name")]
    return group(daily, by, avg_daily_sales=X.mean("daily_total")).orderBy("day_of_week")


def month_seasonality(monthly: DataFrame) -> DataFrame:
    """Average month total per calendar month; input is one row per year and month."""
    name = X.month_name(F.make_date(F.lit(2000), F.col("month"), F.lit(1)))
    out = group(monthly, ["month", name.alias("month_name")], avg_monthly_sales=X.mean("monthly_total"))
    return out.orderBy("month")


# ---- dashboard views -------------------------------------------------------------------------------------------------


def _activity(unique: bool = True) -> dict[str, Column]:
    out = {
        "transaction_count": X.rows(),
        "total_items_sold": F.sum(UNITS),
        "total_sales": X.total(AMOUNT),
        "avg_transaction_value": X.mean(AMOUNT),
    }
    if unique:
        out["unique_customers"] = F.count_distinct("customer_name")
    return out


def daily_overview(sales: DataFrame) -> DataFrame:
    return group(sales, [X.as_date(TS).alias("sale_date")], **_activity())


def monthly_trends(sales: DataFrame) -> DataFrame:
    return group(sales, [F.year(TS).alias("year"), F.month(TS).alias("month")], **_activity())


def category_performance(sales: DataFrame) -> DataFrame:
    return group(sales, ["product_category"], **_activity(), avg_price=X.mean("price"))


def store_overview(sales: DataFrame) -> DataFrame:
    out = group(sales, ["store_id"], **_activity())
    return out.withColumn("revenue_per_customer", X.ratio("total_sales", "unique_customers"))


def weekday_overview(sales: DataFrame) -> DataFrame:
    by = [F.dayofweek(TS).alias("day_of_week"), X.weekday_name(TS).alias("day_name")]
    return group(sales, by, **_activity(unique=False))


def hourly_overview(sales: DataFrame) -> DataFrame:
    return group(sales, [F.hour(TS).alias("hour_of_day")], **_activity(unique=False))


def _purchases() -> dict[str, Column]:
    return {
        "transaction_count": X.rows(),
        "total_items_purchased": F.sum(UNITS),
        "total_spend": X.total(AMOUNT),
        "avg_transaction_value": X.mean(AMOUNT),
    }


def customer_patterns(sales: DataFrame) -> DataFrame:
    first, last = F.min(X.as_date(TS)), F.max(X.as_date(TS))
    return group(
        sales, ["customer_name"], **_purchases(),
        first_purchase_date=first, last_purchase_date=last, customer_lifespan_days=F.datediff(last, first),
    )


def product_ranking(sales: DataFrame) -> DataFrame:
    out = group(
        sales, ["product_name", "product_category"], transaction_count=X.rows(), total_quantity_sold=F.sum(UNITS),
        total_sales=X.total(AMOUNT), avg_price=X.mean("price"),
    )
    return out.orderBy(F.desc("total_quantity_sold"), "product_name", "product_category")


def customer_ranking(sales: DataFrame) -> DataFrame:
    out = group(sales, ["customer_name"], **_purchases(), last_purchase_date=F.max(X.as_date(TS)))
    return out.orderBy(F.desc("total_spend"), "customer_name")


# ---- month comparisons -----------------------------------------------------------------------------------------------


def year_over_year(monthly: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each month against the same month one year before, by a calendar frame: the fact is read once, nothing is joined."""
    index = F.col("year") * 12 + F.col("month")
    before = Window.partitionBy(*keys).orderBy(index).rangeBetween(-12, -12)
    paired = monthly.withColumn("prev_total", F.sum("monthly_total").over(before))
    gain = F.col("monthly_total") - F.col("prev_total")
    return paired.select(
        *keys,
        "year",
        "month",
        X.double("monthly_total").alias("monthly_sales"),
        X.double("prev_total").alias("prev_year_sales"),
        X.double(gain).alias("yoy_difference"),
        (X.ratio(gain, "prev_total") * 100).alias("yoy_growth_pct"),
    ).orderBy(*keys, "year", "month")


def year_month_table(monthly: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """Months down, years across. Without ``years`` they are those that occur, read from the monthly totals (written first, so
    that the sales behind them are added up once)."""
    if years is None:
        monthly = materialise(monthly)
        years = sorted(r["year"] for r in years_present(monthly).collect())  # one row a year
    pivoted = monthly.groupBy("month").pivot("year", list(years)).agg(X.total("monthly_total"))
    named = [F.col(str(y)).alias(f"y{y}") for y in years]
    return pivoted.select("month", *named).orderBy("month")


def years_present(monthly: DataFrame) -> DataFrame:
    return monthly.select("year").distinct()


# ---- distinct counts of any range of days --------------------------------------------------------------------------------


SKETCH_BITS = 12  # registers of a sketch: 2**12, for a standard error of about 1.04 / 2**6 = 1.6 %


def daily_sketches(sales: DataFrame, column: str = "customer_name", keys: Sequence[str] = (), bits: int = SKETCH_BITS) -> DataFrame:
    """One row per day (and key): lines, total, and a sketch of the different values of ``column``, of fixed size.

    Written as a table, it answers for any range of days: sketches unite, where distinct counts don't add up.
    """
    day = X.as_date(TS).alias("sale_date")
    return sales.groupBy(day, *keys).agg(X.rows().alias("lines"), F.sum(AMOUNT).alias("total"), F.hll_sketch_agg(column, bits).alias("sketch"))


def united(sketches: DataFrame, by: Sequence[Column | str] = ()) -> DataFrame:
    """Lines, total and about how many different values there are in the given rows of ``daily_sketches``, together or per group."""
    return sketches.groupBy(*by).agg(
        F.sum("lines").alias("lines"), X.total("total").alias("total_sales"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("about_distinct")
    )
