"""The canonical sales fact, assembled from a star of Parquet tables.

Only the tables that supply a requested column are joined: the foreign keys are total, so a dimension that contributes no
column cannot change the rows, and Catalyst cannot drop an inner join by itself. No join is hinted. Spark broadcasts a side
whose measured size is under its threshold and otherwise shuffles, and AQE splits a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
_UNITS = "CAST(l_quantity AS BIGINT)"

# canonical column -> (tables needed beside lineitem, SQL expression)
COLUMNS: dict[str, tuple[tuple[str, ...], str]] = {
    "transaction_id": ((), "l_orderkey"),
    "product_id": ((), "l_partkey"),
    "quantity_sold": ((), "CAST(l_quantity AS INT)"),
    "total_amount": ((), "CAST(l_extendedprice AS DECIMAL(12,2))"),
    # unit price rounded half up to the cent, in whole numbers so that no binary fraction decides a tie
    "price": ((), f"CAST(((2 * {_CENTS} + {_UNITS}) div (2 * {_UNITS})) * 0.01BD AS DECIMAL(12,2))"),
    "stock_availability": ((), "l_linestatus"),
    "return_flag": ((), "l_returnflag"),
    "date_of_sale": (("orders",), "o_orderdate"),
    "payment_method": (("orders",), "o_orderpriority"),
    "customer_name": (("orders", "customer"), "c_name"),
    "erp_module": (("orders", "customer"), "c_mktsegment"),
    "location": (("orders", "customer", "nation"), "n_name"),
    "product_name": (("part",), "p_name"),
    "category": (("part",), "p_type"),
    "product_category": (("part",), "p_type"),
    "employee_name": (("supplier",), "s_name"),
    "store_id": (("supplier",), "s_nationkey"),
}

_JOINS = (
    ("orders", "l_orderkey", "o_orderkey"),
    ("customer", "o_custkey", "c_custkey"),
    ("nation", "c_nationkey", "n_nationkey"),
    ("part", "l_partkey", "p_partkey"),
    ("supplier", "l_suppkey", "s_suppkey"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _join(fact: DataFrame, spark: SparkSession, sf_dir: str, columns: tuple[str, ...]) -> DataFrame:
    needed = {t for c in columns for t in COLUMNS[c][0]}
    for name, left, right in _JOINS:
        if name in needed:
            fact = fact.join(table(spark, sf_dir, name), F.col(left) == F.col(right))
    return fact


def sales(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Sales lines with the named canonical columns."""
    fact = _join(table(spark, sf_dir, "lineitem"), spark, sf_dir, columns)
    return fact.select(*(_expression(c) for c in columns))


def order_amounts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``total_amount`` per order with the named columns of orders and customers: all that sums by date need.

    The lines of an order are added up before the join, on the key the join shuffles by anyway. An order holding a large
    share of the lines shrinks to one row per map task before it moves.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(_expression("total_amount")).alias("total_amount"))
    return _join(lines, spark, sf_dir, columns).select(*(_expression(c) for c in columns), "total_amount")


def _expression(name: str) -> Column:
    return F.expr(COLUMNS[name][1]).alias(name)


def event_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click-stream rows in the shape of sales lines: the only table with a time of day."""
    events = table(spark, sf_dir, "events")
    return events.select(*event_columns())


def event_columns() -> list[Column]:
    return [
        F.col("event_id").alias("transaction_id"),
        F.col("user_id").alias("customer_name"),
        F.col("event_type").alias("category"),
        F.col("ts").alias("date_of_sale"),
        F.lit(1).alias("quantity_sold"),
        F.col("value").cast("decimal(12,2)").alias("total_amount"),
    ]


def version(spark: SparkSession, sf_dir: str) -> tuple:
    """Name, size and time of every file of the tables: another value once one of them has been written again."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True)
    found = []
    while files.hasNext():
        status = files.next()
        found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(sorted(found))
