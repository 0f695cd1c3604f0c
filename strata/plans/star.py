"""The star schema: calendar, dimensions and facts as plain DataFrame functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.columns import date_key
from strata.operators.joins import inherit_keys, live_interval, lookup, pit_join
from strata.operators.surrogate import stable_sk


def dim_date(
    spark: SparkSession,
    start: dt.date = dt.date(2026, 1, 1),
    end: dt.date = dt.date(2026, 12, 31),
) -> DataFrame:
    """One row per calendar day between two dates, both included."""
    day = F.col("full_date")
    return (
        spark.range(1)
        .select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("full_date"))
        .select(
            date_key(day).alias("date_sk"),
            day,
            F.year(day).alias("year"),
            F.month(day).alias("month"),
            F.dayofmonth(day).alias("day"),
            F.quarter(day).alias("quarter"),
            F.date_format(day, "EEEE").alias("day_name"),
            F.date_format(day, "MMMM").alias("month_name"),
            (F.weekday(day) >= 5).alias("is_weekend"),
        )
    )


def dim_customer(customer: DataFrame) -> DataFrame:
    return customer


def dim_product(product: DataFrame) -> DataFrame:
    return product


def dim_store(
    store: DataFrame, previous: DataFrame | None = None, first: int | None = None
) -> DataFrame:
    """Current stores with surrogate keys, which stores of a previous build keep."""
    return stable_sk(store, ["store_id"], "store_sk", previous, first)


def dim_supplier(
    supplier: DataFrame, previous: DataFrame | None = None, first: int | None = None
) -> DataFrame:
    return stable_sk(supplier, ["supplier_id"], "supplier_sk", previous, first)


def _store_key(store: DataFrame) -> str:
    return "store_sk" if "store_sk" in store.columns else "store_id"


def _with_store(fact: DataFrame, store: DataFrame) -> DataFrame:
    """The store's surrogate key if the dimension has one; its own id otherwise."""
    key = _store_key(store)
    return lookup(fact, store, ["store_id"], [key]) if key == "store_sk" else fact


def sale_customer(
    sold: DataFrame, customer: DataFrame, closed: str = "left", strategy: str = "auto"
) -> DataFrame:
    """Sales, or the orders they belong to, with the customer version valid on their day.

    Customer and day belong to the order, so all of its lines get the version the order gets.
    """
    return pit_join(sold, customer, ["customer_id"], "sale_date", "customer_sk", closed, strategy)


def fact_sales(
    sales: DataFrame,
    customer: DataFrame,
    product: DataFrame,
    store: DataFrame,
    closed: str = "left",
    strategy: str = "auto",
) -> DataFrame:
    """Sales lines with the customer and product versions valid on the day of sale.

    ``stock_code`` stays as a degenerate column: with ``invoice_id`` it is the grain. Sales that
    have ``customer_sk`` already, from ``sale_customer`` over their orders, keep it.
    """
    known = "customer_sk" in sales.columns
    lines = sales.select(
        "invoice_id", "stock_code", "customer_sk" if known else "customer_id", "store_id", "sale_date",
        "quantity", "unit_price",
    )
    keyed = lines if known else sale_customer(lines, customer, closed, strategy)
    keyed = pit_join(keyed, product, ["stock_code"], "sale_date", "product_sk", closed, strategy)
    return _with_store(keyed, store).select(
        "invoice_id",
        "stock_code",
        "customer_sk",
        "product_sk",
        _store_key(store),
        date_key(F.col("sale_date")).alias("date_sk"),
        "sale_date",
        "quantity",
        "unit_price",
        (F.col("quantity") * F.col("unit_price")).alias("line_total"),
    )


def fact_returns(
    returns: DataFrame, sales_fact: DataFrame, on_stock_code: bool = True
) -> DataFrame:
    """Returns with the keys their original sale was given.

    With ``on_stock_code=False`` only the invoice is compared, as for data with one line per
    invoice; an invoice with several lines then lends one of them and never doubles a return.
    """
    on = ["original_invoice_id", "stock_code"] if on_stock_code else ["original_invoice_id"]
    sold = sales_fact.withColumnRenamed("invoice_id", "original_invoice_id")
    keyed = inherit_keys(returns, sold, on, ["customer_sk", "product_sk"])
    return keyed.select(
        "return_invoice_id", "original_invoice_id", "customer_sk", "product_sk", "quantity"
    )


def fact_online_orders(
    orders: DataFrame,
    customer: DataFrame,
    product: DataFrame,
    closed: str = "left",
    strategy: str = "auto",
) -> DataFrame:
    lines = orders.select("order_id", "customer_id", "stock_code", "order_status", "order_date")
    keyed = pit_join(lines, customer, ["customer_id"], "order_date", "customer_sk", closed, strategy)
    keyed = pit_join(keyed, product, ["stock_code"], "order_date", "product_sk", closed, strategy)
    return keyed.select("order_id", "customer_sk", "product_sk", "order_status", "order_date")


def fact_shipping(shipping: DataFrame, orders_fact: DataFrame) -> DataFrame:
    keyed = inherit_keys(shipping, orders_fact, ["order_id"], ["customer_sk"])
    return keyed.select("shipment_id", "order_id", "customer_sk", "carrier", "ship_date")


def fact_inventory_snapshot(
    inventory: DataFrame,
    product: DataFrame,
    store: DataFrame,
    closed: str = "left",
    strategy: str = "auto",
) -> DataFrame:
    levels = inventory.select("store_id", "stock_code", "snapshot_date", "stock_on_hand")
    keyed = pit_join(levels, product, ["stock_code"], "snapshot_date", "product_sk", closed, strategy)
    return _with_store(keyed, store).select(
        _store_key(store), "product_sk", "snapshot_date", "stock_on_hand"
    )


def bridge_promotions(
    promotions: DataFrame, product: DataFrame, closed: str = "left", strategy: str = "auto"
) -> DataFrame:
    """Promotions with the product version valid on their first day."""
    keyed = pit_join(promotions, product, ["stock_code"], "start_date", "product_sk", closed, strategy)
    return keyed.select("promo_id", "product_sk", "start_date", "end_date", "discount_pct")


def sales_promotions(sales: DataFrame, promotions: DataFrame) -> DataFrame:
    """Sales with the promotion live on their day; the highest discount, then the smaller id."""
    keyed = live_interval(
        sales,
        promotions,
        ["stock_code"],
        "sale_date",
        "start_date",
        "end_date",
        best=[F.desc_nulls_last("discount_pct"), F.asc_nulls_last("promo_id")],
        values=["promo_id", "discount_pct"],
    )
    return keyed.select("invoice_id", "stock_code", "sale_date", "promo_id", "discount_pct")
