"""CSV and record input, and the written outputs of the library."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillspark.operators import clean
from tillspark.schemas import CSV_HEADERS
from tillspark.session import scratch_path

# Column types of a CSV export after parsing.
CSV_TYPES = {
    "transaction_id": "bigint",
    "quantity_sold": "int",
    "price": "decimal(12,2)",
    "total_amount": "decimal(12,2)",
    "date_of_sale": "date",
}


def read_csv(spark: SparkSession, path: str, headers: dict[str, str] = CSV_HEADERS) -> DataFrame:
    """Sales export with readable headers. Text comes in as text: bad numbers turn null, a bad date stops the job."""
    schema = T.StructType([T.StructField(h, T.StringType()) for h in headers])
    raw = clean.rename(spark.read.csv(path, header=True, schema=schema, enforceSchema=False), headers)
    typed = {
        c: F.to_date(F.to_timestamp(c)) if kind == "date" else F.col(c).try_cast(kind)
        for c, kind in CSV_TYPES.items()
        if c in raw.columns
    }
    return raw.withColumns(typed)


def write_csv(sales: DataFrame, path: str | None = None, headers: dict[str, str] = CSV_HEADERS) -> str:
    """Write canonical columns under their export headers; returns the folder."""
    path = path or scratch_path(sales.sparkSession, "sales-csv")
    dates = {c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS") for c, k in sales.dtypes if k.startswith("timestamp") or k == "date"}
    back = {column: header for header, column in headers.items()}
    clean.rename(sales.withColumns(dates), back).write.mode("overwrite").csv(path, header=True)
    return path


RECORD = T.StructType([T.StructField("date", T.StringType()), T.StructField("sales", T.DoubleType())])


def parse_records(records: DataFrame, column: str) -> DataFrame:
    """JSON records ``{"date", "sales"}`` to rows; a record without both fields stops the job."""
    parsed = records.select(F.from_json(column, RECORD).alias("r")).select(
        F.to_timestamp("r.date").alias("date"), F.col("r.sales").alias("sales")
    )
    whole = F.col("date").isNotNull() & F.col("sales").isNotNull()
    return parsed.filter(F.when(whole, True).otherwise(F.raise_error(F.lit("records must contain 'date' and 'sales'")).cast("boolean")))


def records_frame(spark: SparkSession, records: list[dict]) -> DataFrame:
    """A handful of in-line records (one scoring request) as rows."""
    if not records or any("date" not in r or "sales" not in r for r in records):
        raise ValueError("records must contain 'date' and 'sales'")
    rows = [(str(r["date"]), float(r["sales"])) for r in records]
    return spark.createDataFrame(rows, RECORD).withColumn("date", F.to_timestamp("date"))


def write_sales(sales: DataFrame, path: str, ts: str = "date_of_sale") -> None:
    """Parquet partitioned by month, so that date filters prune folders. Rows are spread within a month by a hash of the
    row, and a large month is split by AQE, so no single writer holds a hot month."""
    month = F.date_format(ts, "yyyy-MM")
    spread = sales.withColumn("sale_month", month).hint("rebalance", "sale_month")
    spread.write.mode("overwrite").partitionBy("sale_month").parquet(path)


def read_sales(spark: SparkSession, path: str, first: dt.date | None = None, last: dt.date | None = None, ts: str = "date_of_sale") -> DataFrame:
    """Sales of the days ``first`` to ``last`` from the month folders of ``write_sales``; folders of other months are not opened."""
    lines = spark.read.parquet(path)
    month, day = F.col("sale_month"), F.to_date(ts)
    if first is not None:
        lines = lines.filter((month >= first.strftime("%Y-%m")) & (day >= F.lit(first)))
    if last is not None:
        lines = lines.filter((month <= last.strftime("%Y-%m")) & (day <= F.lit(last)))
    return lines


def sales_on(spark: SparkSession, path: str, days: DataFrame, ts: str = "date_of_sale") -> DataFrame:
    """Sales of the days of a table (column ``sale_date``): its months prune the folders when the join runs."""
    spine = days.select(F.to_date("sale_date").alias("_day"), F.date_format("sale_date", "yyyy-MM").alias("_month")).distinct()
    lines = spark.read.parquet(path)
    return lines.join(spine, (lines["sale_month"] == F.col("_month")) & (F.to_date(lines[ts]) == F.col("_day")), "left_semi")


def last_month(spark: SparkSession, path: str) -> DataFrame:
    """Sales of the newest month folder, whose name is found without reading a row."""
    lines = spark.read.parquet(path)
    newest = lines.select("sale_month").distinct().agg(F.max("sale_month")).first()[0]
    return lines.filter(F.col("sale_month") == newest)


def write_table(df: DataFrame, path: str | None = None, name: str = "table") -> DataFrame:
    """Write a result to the shared folder and return a frame that reads it."""
    path = path or scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def publish_views(sales: DataFrame, views: dict[str, Callable[[DataFrame], DataFrame]]) -> list[str]:
    """Register named dashboard views over a sales fact."""
    for name, build in views.items():
        build(sales).createOrReplaceTempView(name)
    return list(views)
