"""Column expressions shared by the operators. All stay on the JVM side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def double(c: Column | str) -> Column:
    return col(c).cast("double")


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """``top / bottom``; null when the denominator is zero or null."""
    return F.try_divide(double(top), double(bottom))


def total(c: Column | str) -> Column:
    """Exact decimal (or integer) sum, reported as a double."""
    return double(F.sum(c))


def mean(c: Column | str) -> Column:
    """Average through the exact sum, so the answer does not depend on how rows were partitioned."""
    return F.try_divide(double(F.sum(c)), F.count(c))


def mean_over(c: Column | str, window) -> Column:
    return F.try_divide(double(F.sum(c).over(window)), F.count(c).over(window))


def rows() -> Column:
    return F.count(F.lit(1))


def as_date(c: Column | str) -> Column:
    return F.to_date(c)


def day_number(c: Column | str) -> Column:
    return F.unix_date(F.to_date(c))


def month_index(c: Column | str) -> Column:
    """Months since year 0: consecutive months differ by one."""
    return F.year(c) * 12 + F.month(c) - 1


def year_month(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM")


def weekday_name(c: Column | str) -> Column:
    return F.date_format(c, "EEEE")


def month_name(c: Column | str) -> Column:
    return F.date_format(c, "MMMM")


# Default price limits, in dollars.
PRICE_LIMITS = (10, 25, 50, 100)


def price_labels(limits: Sequence[int] = PRICE_LIMITS) -> list[str]:
    middle = [f"${low}-${high}" for low, high in zip(limits, limits[1:])]
    return [f"Under ${limits[0]}", *middle, f"Over ${limits[-1]}"]


def bucket_position(price: Column | str, limits: Sequence[int] = PRICE_LIMITS) -> Column:
    """1-based bucket number; a null price falls into the last bucket."""
    chain = F.when(col(price) < limits[0], 1)
    for position, limit in enumerate(limits[1:], start=2):
        chain = chain.when(col(price) < limit, position)
    return chain.otherwise(len(limits) + 1)


def price_bucket(price: Column | str, limits: Sequence[int] = PRICE_LIMITS) -> Column:
    labels = F.array(*(F.lit(label) for label in price_labels(limits)))
    return F.element_at(labels, bucket_position(price, limits))


def recode(c: Column | str, mapping: dict) -> Column:
    """Map listed values, null for anything else."""
    chain = None
    for source, target in mapping.items():
        hit = col(c) == F.lit(source)
        chain = F.when(hit, F.lit(target)) if chain is None else chain.when(hit, F.lit(target))
    return chain


def hash_fraction(columns: Sequence[str], seed: int, buckets: int = 100) -> Column:
    """Stable pseudo-random bucket of a row, independent of partitioning."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(buckets))
