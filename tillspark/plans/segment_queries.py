"""Customer segments, scores and product pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillspark.functions import exprs as X
from tillspark.operators import kpi, ordering, segment, series
from tillspark.operators import anomaly
from tillspark.plans.kpi_queries import AMOUNT, MEAN, UNITS
from tillspark.plans.registry import query, rounded
from tillspark.schemas import NUMERIC_COLUMNS
from tillspark.sources import files
from tillspark.sources.star import event_sales, sales

AS_OF = "2001-08-02"  # the day after the last sale of the test tables
LINES = ("customer_name", "date_of_sale", "quantity_sold", "total_amount")


def metrics_sql(count: int = 10, spend: int = 1000) -> str:
    """Customer figures with the segment decided by nested conditions."""
    return f"""m AS (SELECT customer_name, count(*) AS transaction_count, {AMOUNT} AS total_spend,
      {MEAN} AS avg_transaction_value, {UNITS} AS total_items,
      CAST(sum(quantity_sold) AS DOUBLE) / count(quantity_sold) AS avg_items_per_transaction,
      {AMOUNT} / CAST(sum(quantity_sold) AS DOUBLE) AS avg_spend_per_item, max(d) AS last_purchase_date,
      date_diff('day', max(d), DATE '{AS_OF}') AS days_since_last_purchase FROM sales GROUP BY customer_name),
    labelled AS (SELECT *, CASE WHEN days_since_last_purchase <= 30 THEN
        CASE WHEN transaction_count >= {count} THEN
            CASE WHEN total_spend >= {spend} THEN 'High-Value Loyal' ELSE 'Loyal' END
          WHEN total_spend >= {spend} THEN 'Big Spender' ELSE 'Recent Customer' END
      WHEN transaction_count >= {count} THEN 'Frequent Customer'
      WHEN total_spend >= {spend} THEN 'High Spender'
      WHEN days_since_last_purchase > 180 THEN 'Churned' ELSE 'Average Customer' END AS customer_segment FROM m)"""


@query("agg_customer_metrics", f"WITH {metrics_sql()} SELECT * FROM labelled")
def agg_customer_metrics(spark, d):
    return segment.customer_metrics(sales(spark, d, *LINES), AS_OF).orderBy(F.desc("total_spend"), "customer_name")


@query("agg_customer_metrics_scaled", f"WITH {metrics_sql(40, 1050000)} SELECT * FROM labelled")
def agg_customer_metrics_scaled(spark, d):
    """Limits near the medians of the test tables, so that every segment occurs."""
    found = segment.customer_metrics(sales(spark, d, *LINES), AS_OF, min_count=40, min_spend=1_050_000)
    return found.orderBy(F.desc("total_spend"), "customer_name")


SUMMARY_SQL = """SELECT customer_segment, count(*) AS segment_size, round(avg(total_spend), 7) AS avg_total_spend,
    round(avg(transaction_count), 6) AS avg_transaction_count, round(avg(avg_transaction_value), 7) AS avg_transaction_value,
    round(avg(days_since_last_purchase), 6) AS avg_days_since_last_purchase FROM labelled GROUP BY customer_segment"""


def _summary(metrics):
    out = segment.segment_summary(metrics)
    out = rounded(out, "avg_transaction_count", "avg_days_since_last_purchase", digits=6)
    return rounded(out, "avg_total_spend", "avg_transaction_value", digits=7)


@query("agg_segment_summary", f"WITH {metrics_sql()} {SUMMARY_SQL}")
def agg_segment_summary(spark, d):
    return _summary(segment.customer_metrics(sales(spark, d, *LINES), AS_OF))


@query("agg_segment_summary_scaled", f"WITH {metrics_sql(40, 1050000)} {SUMMARY_SQL}")
def agg_segment_summary_scaled(spark, d):
    return _summary(segment.customer_metrics(sales(spark, d, *LINES), AS_OF, min_count=40, min_spend=1_050_000))


@query(
    "seg_rfm",
    f"""WITH c AS (SELECT customer_name, date_diff('day', max(d), DATE '{AS_OF}') AS recency, count(*) AS frequency,
      sum(total_amount) AS monetary FROM sales GROUP BY customer_name),
    t AS (SELECT *, CAST(ntile(5) OVER (ORDER BY recency DESC, customer_name) AS INTEGER) AS r,
      CAST(ntile(5) OVER (ORDER BY frequency, customer_name) AS INTEGER) AS f,
      CAST(ntile(5) OVER (ORDER BY monetary, customer_name) AS INTEGER) AS m FROM c)
    SELECT customer_name, recency, frequency, CAST(monetary AS DOUBLE) AS monetary, r AS r_score, f AS f_score, m AS m_score,
    concat(r, f, m) AS rfm_score, CASE
      WHEN least(r, f, m) >= 4 THEN 'Champions' WHEN least(r, f, m) >= 3 THEN 'Loyal Customers'
      WHEN r >= 3 AND m >= 2 THEN 'Potential Loyalists' WHEN r >= 4 AND f <= 2 AND m <= 2 THEN 'New Customers'
      WHEN r <= 2 AND least(f, m) >= 3 THEN 'At Risk Customers' WHEN r <= 2 AND least(f, m) >= 2 THEN 'Need Attention'
      WHEN greatest(r, f, m) <= 2 THEN 'Hibernating' ELSE 'Others' END AS customer_segment FROM t""",
)
def seg_rfm(spark, d):
    return segment.rfm_segments(sales(spark, d, "customer_name", "date_of_sale", "total_amount"), AS_OF)


@query(
    "win_ntile",
    """SELECT customer_name, CAST(ntile(7) OVER (ORDER BY sum(total_amount), customer_name) AS INTEGER) AS tile
    FROM sales GROUP BY customer_name""",
)
def win_ntile(spark, d):
    spend = sales(spark, d, "customer_name", "total_amount").groupBy("customer_name").agg(F.sum("total_amount").alias("spend"))
    return ordering.ntile(spend, ["spend", "customer_name"], 7).select("customer_name", "tile")


@query(
    "proc_ltv",
    f"""WITH c AS (SELECT customer_name, count(*) AS transaction_count, {AMOUNT} AS total_spend,
      date_diff('day', min(d), max(d)) AS customer_lifespan_days FROM sales GROUP BY customer_name)
    SELECT *, total_spend / greatest(customer_lifespan_days, 1) AS spend_per_day,
    total_spend / greatest(customer_lifespan_days, 1) * 365 AS annual_value,
    total_spend / greatest(customer_lifespan_days, 1) * 365 * 3 AS estimated_3year_ltv FROM c""",
)
def proc_ltv(spark, d):
    return segment.lifetime_value(sales(spark, d, "customer_name", "date_of_sale", "total_amount"))


@query(
    "agg_customer_features",
    f"""SELECT customer_name, {AMOUNT} AS total_spend, {MEAN} AS average_transaction_value,
    count(total_amount) AS transaction_count, {UNITS} AS total_items,
    CAST(sum(quantity_sold) AS DOUBLE) / count(quantity_sold) AS average_items_per_transaction,
    CAST(sum(price) AS DOUBLE) / count(price) AS average_price,
    {AMOUNT} / CAST(sum(quantity_sold) AS DOUBLE) AS average_spend_per_item FROM sales GROUP BY customer_name""",
)
def agg_customer_features(spark, d):
    return segment.customer_features(sales(spark, d, "customer_name", *NUMERIC_COLUMNS))


PAIR_SQL = "FROM {0} a JOIN {0} b ON a.transaction_id = b.transaction_id AND a.product_name < b.product_name"
PCT_SQL = "CAST(count(*) * 100 AS DOUBLE) / (SELECT count(DISTINCT transaction_id) FROM sales) AS pct_of_transactions"


@query(
    "proc_affinity",
    f"""SELECT a.product_name AS product_a, b.product_name AS product_b, count(*) AS pair_frequency, {PCT_SQL}
    {PAIR_SQL.format('sales')} GROUP BY 1, 2 HAVING count(*) > 5""",
)
def proc_affinity(spark, d):
    return segment.product_affinity(sales(spark, d, "transaction_id", "product_name"))


@query(
    "proc_affinity_distinct",
    f"""WITH u AS (SELECT DISTINCT transaction_id, product_name FROM sales)
    SELECT a.product_name AS product_a, b.product_name AS product_b, count(*) AS pair_frequency, {PCT_SQL}
    {PAIR_SQL.format('u')} GROUP BY 1, 2 HAVING count(*) > 5""",
)
def proc_affinity_distinct(spark, d):
    return segment.product_affinity(sales(spark, d, "transaction_id", "product_name"), distinct_items=True)


@query(
    "join_inner_self_theta",
    f"SELECT a.transaction_id, a.product_name AS product_a, b.product_name AS product_b, count(*) AS n {PAIR_SQL.format('sales')} GROUP BY 1, 2, 3",
)
def join_inner_self_theta(spark, d):
    return segment.item_pairs(sales(spark, d, "transaction_id", "product_name"))[1]


VIEWS = {
    "vw_daily_sales_overview": kpi.daily_overview,
    "vw_monthly_sales_trends": kpi.monthly_trends,
    "vw_product_category_performance": kpi.category_performance,
    "vw_customer_purchase_patterns": kpi.customer_patterns,
    "vw_store_performance": kpi.store_overview,
    "vw_sales_by_day_of_week": kpi.weekday_overview,
    "vw_sales_by_hour": kpi.hourly_overview,
    "vw_top_selling_products": kpi.product_ranking,
    "vw_top_customers": kpi.customer_ranking,
    "vw_sales_anomalies": lambda fact: anomaly.zscore_anomalies(series.daily_totals(fact)),
}


@query(
    "snk_view",
    """WITH t AS (SELECT count(DISTINCT d) AS days, count(DISTINCT year(d) * 12 + month(d)) AS months, count(DISTINCT product_category) AS categories,
      count(DISTINCT customer_name) AS customers, count(DISTINCT store_id) AS stores, count(DISTINCT dayofweek(d)) AS weekdays, count(DISTINCT product_name || '|' || product_category) AS products FROM sales),
    z AS (SELECT avg(CAST(daily_total AS DOUBLE)) AS m, stddev_pop(CAST(daily_total AS DOUBLE)) AS sd FROM daily)
    SELECT 'vw_daily_sales_overview' AS view_name, days AS lines FROM t UNION ALL SELECT 'vw_monthly_sales_trends', months FROM t
    UNION ALL SELECT 'vw_product_category_performance', categories FROM t UNION ALL SELECT 'vw_customer_purchase_patterns', customers FROM t
    UNION ALL SELECT 'vw_store_performance', stores FROM t UNION ALL SELECT 'vw_sales_by_day_of_week', weekdays FROM t
    UNION ALL SELECT 'vw_sales_by_hour', (SELECT count(DISTINCT hour(ts)) FROM events)
    UNION ALL SELECT 'vw_top_selling_products', products FROM t UNION ALL SELECT 'vw_top_customers', customers FROM t
    UNION ALL SELECT 'vw_sales_anomalies', (SELECT count(*) FROM daily, z WHERE abs((CAST(daily_total AS DOUBLE) - m) / sd) > 2.5)""",
)
def snk_view(spark, d):
    """Publish the ten dashboard views, nine over the sales fact and hours over the events, and count each through SQL."""
    columns = ("product_name", "product_category", "store_id", "price", *LINES)
    hours = "vw_sales_by_hour"
    named = files.publish_views(sales(spark, d, *columns), {n: v for n, v in VIEWS.items() if n != hours})
    named += files.publish_views(event_sales(spark, d), {hours: VIEWS[hours]})
    return spark.sql(" UNION ALL ".join(f"SELECT '{n}' AS view_name, count(*) AS lines FROM {n}" for n in named))
