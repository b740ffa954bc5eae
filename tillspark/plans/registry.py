"""Registry of runnable queries, each with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The checking side's own definition of the sales fact.
SALES_SQL = """
sales AS (
  SELECT l.l_orderkey AS transaction_id, c.c_name AS customer_name, s.s_name AS employee_name,
         o.o_orderdate AS date_of_sale, CAST(o.o_orderdate AS DATE) AS d, l.l_partkey AS product_id,
         p.p_name AS product_name, p.p_type AS category, p.p_type AS product_category,
         CAST(l.l_quantity AS INTEGER) AS quantity_sold,
         CAST(l.l_extendedprice AS DECIMAL(12,2)) AS total_amount,
         CAST(((2 * CAST(round(l.l_extendedprice * 100) AS BIGINT) + CAST(l.l_quantity AS BIGINT))
               // (2 * CAST(l.l_quantity AS BIGINT))) * 0.01 AS DECIMAL(12,2)) AS price,
         s.s_nationkey AS store_id, n.n_name AS location, o.o_orderpriority AS payment_method,
         l.l_linestatus AS stock_availability, c.c_mktsegment AS erp_module, l.l_returnflag AS return_flag
  FROM lineitem l
  JOIN orders o ON o.o_orderkey = l.l_orderkey
  JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN nation n ON n.n_nationkey = c.c_nationkey
  JOIN part p ON p.p_partkey = l.l_partkey
  JOIN supplier s ON s.s_suppkey = l.l_suppkey
)"""

DAILY_SQL = "daily AS (SELECT d AS sale_date, sum(total_amount) AS daily_total FROM sales GROUP BY d)"
MONTHLY_SQL = (
    "monthly AS (SELECT year(d) AS year, month(d) AS month, sum(total_amount) AS monthly_total FROM sales GROUP BY 1, 2)"
)


def on_sales(body: str) -> str:
    """Prefix a statement with the sales fact (and the daily or monthly series when it reads them)."""
    parts = [SALES_SQL]
    if " daily" in body:
        parts.append(DAILY_SQL)
    if " monthly" in body:
        parts.append(MONTHLY_SQL)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        raise ValueError("write the series with generate_series instead")
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(parts)}, {body[5:]}"
    return f"WITH {', '.join(parts)} {body}"


def query(name: str, oracle: str | None = None, sales: bool = True) -> Callable[[Query], Query]:
    """Register a query; ``oracle`` reads ``sales`` unless ``sales=False``."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = on_sales(oracle) if sales else oracle
        return fn

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """Round the named columns: those whose last digits depend on the order of floating-point additions."""
    return df.withColumns({c: F.round(c, digits) for c in columns})
