"""Analyst queries over the star schema.

Money is summed as exact decimals, so totals do not depend on how rows are spread; only the totals
are rounded to cents. Facts without a key form a group of their own unless ``resolved_only``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT = "decimal(28,6)"


def _total(column: str) -> Column:
    return F.sum(F.col(column).cast(EXACT))


def _cents(total: str) -> Column:
    return F.round(total, 2).cast("double")


def _resolved(facts: DataFrame, key: str, resolved_only: bool) -> DataFrame:
    return facts.where(F.col(key).isNotNull()) if resolved_only else facts


def top_customers(sales: DataFrame, n: int = 10, resolved_only: bool = False) -> DataFrame:
    """The n customer versions with the highest revenue; ties go to the smaller key, NULL last."""
    return (
        _resolved(sales, "customer_sk", resolved_only)
        .groupBy("customer_sk")
        .agg(_total("line_total").alias("revenue"))
        .orderBy(F.desc(F.round("revenue", 2)), F.asc_nulls_last("customer_sk"))
        .limit(n)
        .select("customer_sk", _cents("revenue").alias("revenue"))
    )


def revenue_by_country(sales: DataFrame, customer: DataFrame) -> DataFrame:
    """Revenue per country of the customer at the time of sale, highest first.

    Facts are summed per customer version before the join, so it sees each version once.
    """
    per_version = sales.groupBy("customer_sk").agg(_total("line_total").alias("part"))
    return (
        per_version.join(customer.select("customer_sk", "country"), "customer_sk")
        .groupBy("country")
        .agg(F.sum("part").alias("total"))
        .orderBy(F.desc("total"), "country")
        .select("country", _cents("total").alias("revenue"))
    )


def return_rate(
    sales: DataFrame, returns: DataFrame, resolved_only: bool = False
) -> DataFrame:
    """Sold and returned pieces per product version, and their ratio in percent."""
    sold = (
        _resolved(sales, "product_sk", resolved_only)
        .groupBy("product_sk")
        .agg(F.sum("quantity").alias("sold_quantity"))
    )
    back = returns.groupBy("product_sk").agg(F.sum("quantity").alias("back"))
    returned = F.coalesce("back", F.lit(0))
    same = F.col("s.product_sk").eqNullSafe(F.col("b.product_sk"))
    return sold.alias("s").join(back.alias("b"), same, "left").select(
        "s.product_sk",
        "sold_quantity",
        returned.alias("returned_quantity"),
        F.when(F.col("sold_quantity") > 0, returned * F.lit(100.0) / F.col("sold_quantity")).alias(
            "return_percent"
        ),
    )


def latest_stock(inventory: DataFrame, product: DataFrame) -> DataFrame:
    """Newest stock level per store and product, across the product's versions.

    Levels are reduced per product version before its code is looked up.
    """
    store = "store_sk" if "store_sk" in inventory.columns else "store_id"
    per_version = (
        inventory.where(F.col("product_sk").isNotNull())
        .groupBy(store, "product_sk")
        .agg(
            F.max("snapshot_date").alias("day"),
            F.max_by("stock_on_hand", "snapshot_date").alias("level"),
        )
    )
    return (
        per_version.join(product.select("product_sk", "stock_code"), "product_sk")
        .groupBy(store, "stock_code")
        .agg(
            F.max("day").alias("snapshot_date"),
            F.max_by("level", "day").alias("stock_on_hand"),
        )
    )


def preview(df: DataFrame, order_by: list[str], n: int = 10) -> DataFrame:
    """The first n rows in a stated order, as a top-n rather than a full sort."""
    return df.orderBy(*[F.asc_nulls_last(c) for c in order_by]).limit(n)
