"""Customers: metrics, rule-based segments, RFM, lifetime value; and products bought together."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillspark.functions import exprs as X
from tillspark.operators import ordering
from tillspark.session import materialise

# Segments in order of precedence; the first whose traits all hold is taken.
SEGMENT_RULES = (
    ("High-Value Loyal", ("recent", "frequent", "big")),
    ("Loyal", ("recent", "frequent")),
    ("Big Spender", ("recent", "big")),
    ("Recent Customer", ("recent",)),
    ("Frequent Customer", ("frequent",)),
    ("High Spender", ("big",)),
    ("Churned", ("lapsed",)),
)
NO_SEGMENT = "Average Customer"

# RFM segments in order of precedence, with the score ranges of recency, frequency and monetary value.
# "Cannot Lose Them" and "Lost" lie inside earlier ranges and are never reached; the order is part of the definition.
RFM_RULES = (
    ("Champions", (4, 5), (4, 5), (4, 5)),
    ("Loyal Customers", (3, 5), (3, 5), (3, 5)),
    ("Potential Loyalists", (3, 5), (1, 5), (2, 5)),
    ("New Customers", (4, 5), (1, 2), (1, 2)),
    ("At Risk Customers", (1, 2), (3, 5), (3, 5)),
    ("Need Attention", (1, 2), (2, 5), (2, 5)),
    ("Cannot Lose Them", (1, 1), (4, 5), (4, 5)),
    ("Hibernating", (1, 2), (1, 2), (1, 2)),
    ("Lost", (1, 1), (1, 1), (1, 1)),
)
NO_RFM_SEGMENT = "Others"


def _first_match(rules: Sequence[tuple[str, Column]], default: str) -> Column:
    chain = reduce(lambda c, rule: c.when(rule[1], rule[0]), rules[1:], F.when(rules[0][1], rules[0][0]))
    return chain.otherwise(default)


def customer_metrics(
    sales: DataFrame,
    as_of: str,
    recent_days: int = 30,
    min_count: int = 10,
    min_spend: float = 1000,
    lapsed_days: int = 180,
) -> DataFrame:
    """Purchase figures per customer on the day ``as_of``, with a segment."""
    last = F.max(X.as_date("date_of_sale"))
    figures = sales.groupBy("customer_name").agg(
        X.rows().alias("transaction_count"),
        X.total("total_amount").alias("total_spend"),
        X.mean("total_amount").alias("avg_transaction_value"),
        F.sum("quantity_sold").alias("total_items"),
        X.mean("quantity_sold").alias("avg_items_per_transaction"),
        X.ratio(F.sum("total_amount"), F.sum("quantity_sold")).alias("avg_spend_per_item"),
        last.alias("last_purchase_date"),
        F.datediff(F.to_date(F.lit(as_of)), last).alias("days_since_last_purchase"),
    )
    traits = {
        "recent": F.col("days_since_last_purchase") <= recent_days,
        "frequent": F.col("transaction_count") >= min_count,
        "big": F.col("total_spend") >= min_spend,
        "lapsed": F.col("days_since_last_purchase") > lapsed_days,
    }
    rules = [(label, reduce(Column.__and__, (traits[t] for t in wanted))) for label, wanted in SEGMENT_RULES]
    return figures.withColumn("customer_segment", _first_match(rules, NO_SEGMENT))


def segment_summary(metrics: DataFrame) -> DataFrame:
    out = metrics.groupBy("customer_segment").agg(
        X.rows().alias("segment_size"),
        F.avg("total_spend").alias("avg_total_spend"),
        F.avg("transaction_count").alias("avg_transaction_count"),
        F.avg("avg_transaction_value").alias("avg_transaction_value"),
        F.avg("days_since_last_purchase").alias("avg_days_since_last_purchase"),
    )
    return out.orderBy(F.desc("avg_total_spend"))


def rfm_label(r: Column, f: Column, m: Column) -> Column:
    rules = [
        (label, r.between(*rs) & f.between(*fs) & m.between(*ms)) for label, rs, fs, ms in RFM_RULES
    ]
    return _first_match(rules, NO_RFM_SEGMENT)


def rfm_segments(sales: DataFrame, as_of: str, tiles: int = 5) -> DataFrame:
    """Recency, frequency and monetary scores over all customers; ties go by customer name.

    The three rankings share one range sort of the customer table (see ``ordering.ntiles``).
    """
    last = F.max(X.as_date("date_of_sale"))
    customers = sales.groupBy("customer_name").agg(
        F.datediff(F.to_date(F.lit(as_of)), last).alias("recency"),
        X.rows().alias("frequency"),
        F.sum("total_amount").alias("monetary"),
    )
    scores = {"r_score": -F.col("recency"), "f_score": F.col("frequency"), "m_score": F.col("monetary")}
    scored = ordering.ntiles(customers, "customer_name", scores, tiles)
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    position = F.when((r >= 4) & (f >= 4) & (m >= 4), 1).when((r >= 3) & (f >= 3) & (m >= 3), 2).otherwise(3)
    return scored.select(
        "customer_name", "recency", "frequency", X.double("monetary").alias("monetary"),
        "r_score", "f_score", "m_score",
        F.concat(r, f, m).alias("rfm_score"),
        rfm_label(r, f, m).alias("customer_segment"),
    ).orderBy(position, "customer_name")


def lifetime_value(sales: DataFrame, years: int = 3) -> DataFrame:
    """Spend per day between first and last purchase, projected to a year and to ``years`` years.

    A customer seen on one day only counts the whole spend as one day's.
    """
    day = X.as_date("date_of_sale")
    base = sales.groupBy("customer_name").agg(
        X.rows().alias("transaction_count"),
        X.total("total_amount").alias("total_spend"),
        F.datediff(F.max(day), F.min(day)).alias("customer_lifespan_days"),
    )
    days = F.when(F.col("customer_lifespan_days") == 0, 1).otherwise(F.col("customer_lifespan_days"))
    per_day = base.withColumn("spend_per_day", X.ratio("total_spend", days))
    annual = per_day.withColumn("annual_value", F.col("spend_per_day") * 365)
    value = f"estimated_{years}year_ltv"
    return annual.withColumn(value, F.col("annual_value") * years).orderBy(F.desc(value), "customer_name")


def customer_features(sales: DataFrame) -> DataFrame:
    """Numeric description of each customer, the input of clustering."""
    return sales.groupBy("customer_name").agg(
        X.total("total_amount").alias("total_spend"),
        X.mean("total_amount").alias("average_transaction_value"),
        F.count("total_amount").alias("transaction_count"),
        F.sum("quantity_sold").alias("total_items"),
        X.mean("quantity_sold").alias("average_items_per_transaction"),
        X.mean("price").alias("average_price"),
        X.ratio(F.sum("total_amount"), F.sum("quantity_sold")).alias("average_spend_per_item"),
    )


def item_pairs(
    sales: DataFrame,
    basket: str = "transaction_id",
    item: str = "product_name",
    distinct_items: bool = False,
    block: int = 1000,
) -> tuple[DataFrame, DataFrame]:
    """Row pairs of different items per basket, as ``(lines per basket and item, pairs with their multiplicity)``.

    Lines are counted per (basket, item) before they move, so a basket that holds a large share of all lines shrinks to its
    distinct items; these counts are read several times and are therefore checkpointed. A basket of more than ``block``
    items is cut into a grid of cells by item hash: an item of block ``i`` meets an item of block ``j`` only in cell
    ``(i, j)``, so every pair is formed once and no task holds the whole basket.
    """
    lines = materialise(sales.groupBy(basket, item).agg((F.lit(1) if distinct_items else X.rows()).alias("n")))
    sizes = lines.groupBy(basket).agg(F.ceil(X.rows() / block).cast("int").alias("_parts"))
    placed = lines.join(sizes, basket).withColumn("_own", F.pmod(F.xxhash64(item), F.col("_parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    own = F.col("_own")
    left = placed.select(
        basket, own.alias("_i"), every.alias("_j"), F.col(item).alias("product_a"), F.col("n").alias("_na")
    )
    right = placed.select(
        basket, every.alias("_i"), own.alias("_j"), F.col(item).alias("product_b"), F.col("n").alias("_nb")
    )
    pairs = left.join(right, [basket, "_i", "_j"]).filter(F.col("product_a") < F.col("product_b"))
    return lines, pairs.select(basket, "product_a", "product_b", (F.col("_na") * F.col("_nb")).alias("n"))


def product_affinity(
    sales: DataFrame,
    basket: str = "transaction_id",
    item: str = "product_name",
    min_count: int = 5,
    distinct_items: bool = False,
) -> DataFrame:
    """Items bought together more than ``min_count`` times, with their share of all baskets.

    By default a repeated item counts once per line, so the frequency is the number of line pairs.
    """
    lines, pairs = item_pairs(sales, basket, item, distinct_items)
    frequency = pairs.groupBy("product_a", "product_b").agg(F.sum("n").alias("pair_frequency"))
    baskets = lines.agg(F.count_distinct(basket)).scalar()
    return (
        frequency.filter(F.col("pair_frequency") > min_count)
        .withColumn("pct_of_transactions", X.ratio(F.col("pair_frequency") * 100, baskets))
        .orderBy(F.desc("pair_frequency"), "product_a", "product_b")
    )
