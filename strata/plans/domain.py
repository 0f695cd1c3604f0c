"""The retail tables derived from the given order, line, part and supplier tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.dedup import dedup_latest
from strata.operators.scd2 import START, scd2_rebuild
from strata.operators.surrogate import dense_sk


def given(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _text(column: str) -> Column:
    return F.col(column).cast("string")


#: How a key column is shown: ``_text`` as in the retail tables; ``F.col`` leaves it a number, which
#: takes fewer bytes in each shuffle, for queries that show keys as text at their end only.
Keys = Callable[[str], Column]


def _day(column: str) -> Column:
    return F.col(column).cast("date")


#: A line's columns but its key, in the order in which they break ties between rows of one key.
_LINE = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")


def latest_lines(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """One row per order and line number: the one shipped last."""
    return _latest(given(spark, folder, "lineitem"), *more)


def _latest(lines: DataFrame, *more: str) -> DataFrame:
    columns = lines.select("l_orderkey", "l_linenumber", *_LINE, *more)
    return dedup_latest(columns, ["l_orderkey", "l_linenumber"], ["l_shipdate"])


def lines_by_order(spark: SparkSession, folder: str) -> DataFrame:
    """The lines that name an order, dealt out by it.

    ``sales`` and ``returns`` of one query take it, and the lines are shuffled once for both.
    """
    lines = given(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", *_LINE)
    return lines.where("l_orderkey IS NOT NULL").repartition("l_orderkey")


#: What breaks ties between lines of one order and part, in its order, and what sales show of it.
_TIES = ("l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
_SOLD_FROM = {"quantity": ("l_quantity",), "unit_price": ("l_extendedprice", "l_quantity"), "store_id": ("l_suppkey",)}


def sales(
    spark: SparkSession,
    folder: str,
    keys: Keys = _text,
    headers: Callable[[DataFrame], DataFrame] | None = None,
    shared: DataFrame | None = None,
    keep: Iterable[str] | None = None,
) -> DataFrame:
    """One row per order and part, with the order's customer and day.

    The lines are dealt out by order once, which serves the deduplication and the join; a line
    without an order finds none. ``headers`` may add columns to the orders (``customer_id``,
    ``sale_date``) before their lines join them, so that they are found once an order. ``shared``
    are the ``lines_by_order`` that the query reads for something else too.

    ``keep`` names the columns of the result, by default all. Rows of one order and part shipped
    last together differ in ``_TIES``, whose order tells which one stays. It is the same one, as far
    as ``keep`` shows it, without those after the last that ``keep`` needs: they are not shuffled.
    """
    keep = None if keep is None else list(keep)
    needed = [c for c in _TIES if keep is None or any(c in _SOLD_FROM.get(k, ()) for k in keep)]
    ties = _TIES[: _TIES.index(needed[-1]) + 1] if needed else ()
    columns = ["l_orderkey", "l_partkey", *ties, "l_shipdate"]
    if shared is None:
        lines = given(spark, folder, "lineitem").select(*columns)
        lines = lines.where("l_orderkey IS NOT NULL").repartition("l_orderkey")
        lines = dedup_latest(lines, ["l_orderkey", "l_partkey"], ["l_shipdate"])
    else:
        # Two columns more break ties last, which changes no pick but keeps the lines whole, and the
        # keys are copies, so that no filter on them gets below the shuffle: only equal ones are shared.
        copies = [F.col("l_orderkey").alias("_order"), F.col("l_partkey").alias("_part")]
        lines = shared.select(*copies, *columns, "l_returnflag", "l_linestatus")
        lines = dedup_latest(lines, ["_order", "_part"], ["l_shipdate"])
    orders = given(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    own = {"customer_id": keys("o_custkey"), "sale_date": _day("o_orderdate")}
    if headers:
        orders = headers(orders.withColumns(own))
        own = {c: F.col(c) for c in own}
    found = [c for c in orders.columns if c not in ("o_orderkey", "o_custkey", "o_orderdate", *own)]
    shown = {
        "invoice_id": keys("l_orderkey"),
        "stock_code": keys("l_partkey"),
        "quantity": F.col("l_quantity").cast("int"),
        "unit_price": F.col("l_extendedprice") / F.col("l_quantity"),
        "customer_id": own["customer_id"],
        "store_id": keys("l_suppkey"),
        "invoice_date": F.col("o_orderdate").cast("timestamp"),
        "sale_date": own["sale_date"],
        **{c: F.col(c) for c in found},
    }
    sold = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return sold.select(*[shown[c].alias(c) for c in (shown if keep is None else keep)])


def customer_feed(spark: SparkSession, folder: str, keys: Keys = _text) -> DataFrame:
    """Each order reports its customer's country and segment on the day of the order."""
    orders = given(spark, folder, "orders")
    customer = given(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nation = given(spark, folder, "nation").select("n_nationkey", "n_name")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            keys("o_custkey").alias("customer_id"),
            F.col("n_name").alias("country"),
            F.col("o_orderpriority").alias("segment"),
            _day("o_orderdate").alias("feed_date"),
            F.col("o_orderkey").alias("feed_key"),
        )
    )


def within(day: str, since: dt.date | None, before: dt.date | None) -> Column:
    """``since <= day < before``; None leaves an end open, and a NULL day belongs to the open past."""
    past, coming = F.lit(True), F.lit(True)
    if since is not None:
        past = F.coalesce(F.col(day) >= F.lit(since), F.lit(False))
    if before is not None:
        coming = F.coalesce(F.col(day) < F.lit(before), F.lit(True))
    return past & coming


def customer_state(
    spark: SparkSession, folder: str, before: dt.date | None, since: dt.date | None
) -> DataFrame:
    """Each customer's last report in ``[since, before)``, as a daily batch would deliver it."""
    feed = customer_feed(spark, folder)
    reported = feed.where(within("feed_date", since, before))
    return dedup_latest(reported, ["customer_id"], ["feed_date", "feed_key"]).select(
        "customer_id", "country", "segment"
    )


def customer_history(
    spark: SparkSession,
    folder: str,
    initial_start: dt.date | None = None,
    keys: Keys = _text,
    keep: Iterable[str] = ("country", "segment"),
) -> DataFrame:
    """The customers' versions with the columns ``keep``; numbered in the order of the keys' text."""
    return scd2_rebuild(
        customer_feed(spark, folder, keys),
        ["customer_id"],
        ["country", "segment"],
        "customer_sk",
        "feed_date",
        ["feed_key"],
        initial_start=initial_start,
        keep=list(keep),
        order_by=[START, _text("customer_id")],
    )


def product_history(
    spark: SparkSession,
    folder: str,
    keys: Keys = _text,
    keep: Iterable[str] = ("unit_price", "supplier_id"),
) -> DataFrame:
    """Each shipped line reports its part's price and supplier on the day of shipping.

    The versions have the columns ``keep`` and are numbered in the order of the keys' text. The
    supplier only tells rows of one price apart, so versions are the same without it.
    """
    supplier = [_text("l_suppkey").alias("supplier_id")] if "supplier_id" in keep else []
    feed = given(spark, folder, "lineitem").select(
        keys("l_partkey").alias("stock_code"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        *supplier,
        _day("l_shipdate").alias("feed_date"),
        "l_orderkey",
        "l_linenumber",
    )
    return scd2_rebuild(
        feed, ["stock_code"], ["unit_price"], "product_sk", "feed_date", ["l_orderkey", "l_linenumber"],
        keep=list(keep), order_by=[START, _text("stock_code")],
    )


def stores(spark: SparkSession, folder: str, keys: Keys = _text) -> DataFrame:
    supplier = given(spark, folder, "supplier")
    nation = given(spark, folder, "nation")
    region = given(spark, folder, "region")
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            keys("s_suppkey").alias("store_id"),
            F.col("r_name").alias("region"),
            F.col("n_name").alias("country"),
            F.col("s_name").alias("store_name"),
        )
    )


def suppliers(spark: SparkSession, folder: str) -> DataFrame:
    return given(spark, folder, "supplier").select(
        _text("s_suppkey").alias("supplier_id"), F.col("s_name").alias("supplier_name")
    )


def store_dim(spark: SparkSession, folder: str, keys: Keys = _text) -> DataFrame:
    return dense_sk(stores(spark, folder, keys), [_text("store_id")], "store_sk")


def online_orders(spark: SparkSession, folder: str, keys: Keys = _text) -> DataFrame:
    """Orders with their smallest part number as the ordered product."""
    first_part = (
        given(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.min("l_partkey").alias("first_part"))
    )
    orders = given(spark, folder, "orders")
    return orders.join(first_part, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        keys("o_orderkey").alias("order_id"),
        keys("o_custkey").alias("customer_id"),
        keys("first_part").alias("stock_code"),
        F.col("o_orderstatus").alias("order_status"),
        _day("o_orderdate").alias("order_date"),
    )


def _line_id(prefix: str) -> Column:
    return F.concat(F.lit(prefix), _text("l_orderkey"), F.lit("-"), _text("l_linenumber"))


def shipping(spark: SparkSession, folder: str, latest: DataFrame | None = None) -> DataFrame:
    """The lines as last shipped; ``latest`` are the ``latest_lines``, if the caller has them."""
    latest = latest_lines(spark, folder) if latest is None else latest
    return latest.select(
        _line_id("S").alias("shipment_id"),
        _text("l_orderkey").alias("order_id"),
        F.concat(F.lit("carrier "), F.col("l_linestatus")).alias("carrier"),
        _day("l_shipdate").alias("ship_date"),
    )


def returns(
    spark: SparkSession,
    folder: str,
    keys: Keys = _text,
    shared: DataFrame | None = None,
    latest: DataFrame | None = None,
) -> DataFrame:
    """The lines marked as returned, as last shipped; ``shared`` as for ``sales``, ``latest`` as for ``shipping``."""
    latest = latest_lines(spark, folder) if latest is None else latest
    if shared is not None:
        # ``shared`` lacks the lines that name no order. They are returns, if without a sale.
        latest = _latest(shared).unionByName(latest.where("l_orderkey IS NULL"))
    return latest.where(F.col("l_returnflag") == "R").select(
        _line_id("R").alias("return_invoice_id"),
        keys("l_orderkey").alias("original_invoice_id"),
        keys("l_partkey").alias("stock_code"),
        F.col("l_quantity").cast("int").alias("quantity"),
    )


def inventory(spark: SparkSession, folder: str, keys: Keys = _text) -> DataFrame:
    """Pieces per supplier, part and shipping day, read as a stock level."""
    return (
        given(spark, folder, "lineitem")
        .groupBy(
            keys("l_suppkey").alias("store_id"),
            keys("l_partkey").alias("stock_code"),
            _day("l_shipdate").alias("snapshot_date"),
        )
        .agg(F.sum("l_quantity").cast("int").alias("stock_on_hand"))
    )


def promotions(spark: SparkSession, folder: str) -> DataFrame:
    """Each part on offer for ``p_size`` days, starting ``p_size`` months into the data."""
    start = F.add_months(F.lit(dt.date(1995, 1, 1)), F.col("p_size"))
    return given(spark, folder, "part").select(
        F.concat(F.lit("P"), _text("p_partkey")).alias("promo_id"),
        _text("p_partkey").alias("stock_code"),
        start.alias("start_date"),
        F.date_add(start, F.col("p_size")).alias("end_date"),
        (F.col("p_size") / F.lit(100.0)).alias("discount_pct"),
    )


def offers(spark: SparkSession, folder: str, keys: Keys = _text) -> DataFrame:
    """Each line's discount on offer for its part from shipping on, for a day per piece."""
    start = _day("l_shipdate")
    return latest_lines(spark, folder, "l_discount").select(
        _line_id("O").alias("promo_id"),
        keys("l_partkey").alias("stock_code"),
        start.alias("start_date"),
        F.date_add(start, F.col("l_quantity").cast("int")).alias("end_date"),
        F.col("l_discount").alias("discount_pct"),
    )
