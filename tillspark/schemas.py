"""Declared schemas of the sales tables and of the CSV export that feeds them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


def _strings(*names: str) -> T.StructType:
    return _struct(*((name, T.StringType()) for name in names))


ERP_SALES = _struct(
    ("transaction_id", T.IntegerType()),
    ("customer_name", T.StringType()),
    ("product_name", T.StringType()),
    ("category", T.StringType()),
    ("quantity_sold", T.IntegerType()),
    ("price", MONEY),
    ("total_amount", MONEY),
    ("payment_method", T.StringType()),
    ("location", T.StringType()),
    ("date_of_sale", T.DateType()),
    ("stock_availability", T.StringType()),
    ("employee_name", T.StringType()),
    ("erp_module", T.StringType()),
)

SALES_TRANSACTIONS = _struct(
    ("transaction_id", T.StringType()),
    ("customer_name", T.StringType()),
    ("employee_name", T.StringType()),
    ("date_of_sale", T.TimestampType()),
    ("product_id", T.StringType()),
    ("product_name", T.StringType()),
    ("product_category", T.StringType()),
    ("quantity_sold", T.IntegerType()),
    ("price", MONEY),
    ("total_amount", MONEY),
    ("store_id", T.StringType()),
    ("payment_method", T.StringType()),
)

DIM_CUSTOMERS = _strings(
    "customer_id", "customer_name", "customer_email", "customer_phone", "customer_address",
    "customer_city", "customer_state", "customer_zip", "customer_segment",
)

DIM_PRODUCTS = _struct(
    ("product_id", T.StringType()),
    ("product_name", T.StringType()),
    ("product_category", T.StringType()),
    ("product_subcategory", T.StringType()),
    ("product_cost", MONEY),
    ("product_price", MONEY),
)

DIM_STORES = _strings(
    "store_id", "store_name", "store_address", "store_city", "store_state", "store_zip", "store_region",
)

DIM_DATES = _struct(
    ("date_id", T.DateType()),
    ("year", T.IntegerType()),
    ("month", T.IntegerType()),
    ("day", T.IntegerType()),
    ("day_of_week", T.IntegerType()),
    ("quarter", T.IntegerType()),
    ("week_of_year", T.IntegerType()),
    ("is_weekend", T.BooleanType()),
    ("is_holiday", T.BooleanType()),
)

# Header of the CSV export -> column name used by the operators.
CSV_HEADERS = {
    "Transaction ID": "transaction_id",
    "Customer Name": "customer_name",
    "Product Name": "product_name",
    "Category": "category",
    "Quantity Sold": "quantity_sold",
    "Price": "price",
    "Total Amount": "total_amount",
    "Payment Method": "payment_method",
    "Location": "location",
    "Date of Sale": "date_of_sale",
    "Stock Availability": "stock_availability",
    "Employee Name": "employee_name",
    "ERP Module": "erp_module",
}

NUMERIC_COLUMNS = ("quantity_sold", "price", "total_amount")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The declared columns in their declared types and order; a value that does not fit stops the job."""
    return df.select(*(F.col(field.name).cast(field.dataType).alias(field.name) for field in schema))
