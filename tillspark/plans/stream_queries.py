"""Streaming key figures, checked against the batch answer over the days that have closed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillspark.operators import series
from tillspark.plans.registry import query, rounded
from tillspark.sources import star
from tillspark.streaming import daily as streaming
from tillspark.session import materialise

KEYS = ("category",)


def arriving(spark, d):
    schema = star.table(spark, d, "events").schema
    return streaming.read_stream(spark, f"{d}/events.parquet", schema).select(*star.event_columns())


@query(
    "stream_daily_sales",
    """WITH e AS (SELECT event_type AS category, CAST(ts AS DATE) AS sale_date, CAST(value AS DECIMAL(12,2)) AS v FROM events),
    t AS (SELECT category, sale_date, count(*) AS transaction_count, CAST(sum(v) AS DOUBLE) AS total_sales,
      CAST(sum(v) AS DOUBLE) / count(v) AS avg_transaction_value FROM e GROUP BY 1, 2),
    b AS (SELECT category, avg(total_sales) AS m, stddev_pop(total_sales) AS sd FROM t GROUP BY 1)
    SELECT category, sale_date, transaction_count, total_sales, avg_transaction_value,
    round((total_sales - m) / sd, 6) AS z_score,
    CASE WHEN abs((total_sales - m) / sd) > 2 THEN 'Anomaly' ELSE 'Normal' END AS anomaly_status FROM t JOIN b USING (category)
    WHERE CAST(sale_date AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""",
    sales=False,
)
def stream_daily_sales(spark, d):
    past = series.daily_totals(star.event_sales(spark, d), KEYS)
    figures = streaming.daily_figures(arriving(spark, d), KEYS, "1 day")
    known = materialise(streaming.baseline(past, KEYS))  # written once, read by every micro-batch
    days = streaming.run_available(streaming.flag_days(figures, known, KEYS, 2))
    return rounded(days, "z_score", digits=6)


CLOSED_SQL = """e AS (SELECT event_type AS category, CAST(ts AS DATE) AS sale_date, CAST(value AS DECIMAL(12,2)) AS v FROM events),
    t AS (SELECT category, sale_date, count(*) AS transaction_count, CAST(sum(v) AS DOUBLE) AS total_sales,
      CAST(sum(v) AS DOUBLE) / count(v) AS avg_transaction_value FROM e GROUP BY 1, 2)"""


@query(
    "stream_running_baseline",
    f"""WITH {CLOSED_SQL},
    b AS (SELECT *, count(total_sales) OVER w AS days_before, avg(total_sales) OVER w AS m, stddev_pop(total_sales) OVER w AS sd FROM t
      WINDOW w AS (PARTITION BY category ORDER BY sale_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT category, sale_date, transaction_count, total_sales, avg_transaction_value, days_before,
    round(m + 1e-7, 4) AS baseline_mean, round(sd + 1e-7, 4) AS baseline_std, round(CASE WHEN sd > 0 THEN (total_sales - m) / sd END + 1e-7, 4) AS z_score,
    CASE WHEN sd > 0 THEN CASE WHEN abs((total_sales - m) / sd) > 2 THEN 'Anomaly' ELSE 'Normal' END ELSE 'Unknown' END AS anomaly_status
    FROM b WHERE CAST(sale_date AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""",
    sales=False,
)
def stream_running_baseline(spark, d):
    """Closed days against all days of their key that closed before; the baseline is the state of the stream."""
    figures = streaming.daily_figures(arriving(spark, d), KEYS, "1 day")
    days = streaming.run_available(streaming.flag_running(figures, KEYS, 2))
    figures = ("baseline_mean", "baseline_std", "z_score")  # means of cents end in 5 now and then, so they are moved off that edge
    return rounded(days.withColumns({c: F.col(c) + 1e-7 for c in figures}), *figures)


@query(
    "stream_days_so_far",
    f"""WITH {CLOSED_SQL}
    SELECT *, CAST(sale_date AS TIMESTAMP) + INTERVAL 2 DAY > (SELECT max(ts) FROM events) AS is_open,
    (SELECT count(*) FROM events) AS arrived_rows, CAST(0 AS BIGINT) AS late_rows FROM t""",
    sales=False,
)
def stream_days_so_far(spark, d):
    """All days with their newest figures, open ones among them."""
    return streaming.days_so_far(arriving(spark, d), KEYS)
