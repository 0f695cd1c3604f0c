"""Queries by name over the given tables, one per operator or table."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions import rules as R
from strata.functions.columns import date_key, row_hash
from strata.operators.dedup import dedup_latest
from strata.operators.incremental import read_incremental, unprocessed_batches
from strata.operators.joins import fk_audit, inherit_keys, lookup, pit_join
from strata.operators.layout import cluster
from strata.operators.merge import merge_upsert
from strata.operators.quality import (
    FAILED,
    Gate,
    dq_summary,
    dq_violations,
    null_profile,
    quarantine_report,
    validate,
)
from strata.operators.scd2 import (
    END,
    START,
    current_versions,
    scd2_diff,
    scd2_initial,
    scd2_merge,
    scd2_rebuild,
    version_history,
)
from strata.operators.surrogate import dense_sk
from strata.plans import analytics, domain, layers, star
from strata.plans.domain import given
from strata.plans.retail import retail_specs
from strata.session import materialize, session_folder, shuffles_freed, side_by_side, temporary_steps
from strata.sources.catalog import CatalogTables
from strata.sources.landing import CORRUPT, export_landing, read_landing, tag_metadata
from strata.sources.named import NamedTables
from strata.sources.tables import Tables
from strata.spec import TableSpec, to_struct
from strata.streaming.ingest import stream_ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FIRST_CUT = dt.date(1995, 1, 1)
SECOND_CUT = dt.date(1998, 7, 1)
LAST_CUT = dt.date(2002, 1, 1)


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _folder(spark: SparkSession) -> str:
    return f"{session_folder(spark)}/{uuid.uuid4().hex}"


# -- landing, quality and increments ----------------------------------------------------

CUSTOMER_RULES = [
    {"type": "not_null", "column": "customer_id"},
    {"type": "not_null", "column": "segment"},
    {"type": "non_negative", "column": "balance"},
    {"type": "allowed_values", "column": "segment",
     "allowed": ["AUTOMOBILE", "BUILDING", "HOUSEHOLD"]},
]
ORDER_RULES = [
    {"type": "not_null", "column": "order_id"},
    {"type": "allowed_values", "column": "order_status", "allowed": ["F", "O", None]},
    {"type": "no_future_date", "column": "order_date"},
]
RULES_AS_OF = dt.date(2000, 6, 30)


def _checked_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with one segment blanked out, so that every rule finds something."""
    return given(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("customer_id"),
        F.nullif(F.col("c_mktsegment"), F.lit("FURNITURE")).alias("segment"),
        F.col("c_acctbal").alias("balance"),
    )


def _checked_orders(spark: SparkSession, folder: str) -> DataFrame:
    return given(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_orderdate").cast("date").alias("order_date"),
    )


def _customer_rules() -> list[R.Rule]:
    return R.build_all(CUSTOMER_RULES, RULES_AS_OF)


def _order_rules() -> list[R.Rule]:
    return R.build_all(ORDER_RULES, RULES_AS_OF)


def _readable(invalid: DataFrame) -> DataFrame:
    return invalid.withColumn(FAILED, F.array_join(FAILED, "; ")).withColumnRenamed(
        FAILED, "failed_rules"
    )


@query
def read_landing_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Orders written as landing files and read back with a declared schema."""
    orders = _checked_orders(spark, folder)
    path = _folder(spark)
    export_landing(orders, path)
    schema = to_struct(
        [
            {"name": "order_id", "type": "string"},
            {"name": "order_status", "type": "string"},
            {"name": "order_date", "type": "date"},
        ]
    )
    return read_landing(spark, path, schema).where(F.col(CORRUPT).isNull()).drop(CORRUPT)


@query
def tag_audit_columns(spark: SparkSession, folder: str) -> DataFrame:
    moment = dt.datetime(2026, 1, 2, 3, 4, 5, tzinfo=dt.timezone.utc)
    return tag_metadata(_checked_orders(spark, folder), "batch-1", moment, "orders")


@query
def dq_valid(spark: SparkSession, folder: str) -> DataFrame:
    return validate(_checked_customers(spark, folder), _customer_rules()).valid


@query
def dq_invalid(spark: SparkSession, folder: str) -> DataFrame:
    return _readable(validate(_checked_customers(spark, folder), _customer_rules()).invalid)


@query
def dq_valid_orders(spark: SparkSession, folder: str) -> DataFrame:
    return validate(_checked_orders(spark, folder), _order_rules()).valid


@query
def dq_invalid_orders(spark: SparkSession, folder: str) -> DataFrame:
    return _readable(validate(_checked_orders(spark, folder), _order_rules()).invalid)


@query
def dq_summary_customers(spark: SparkSession, folder: str) -> DataFrame:
    return dq_summary(_checked_customers(spark, folder), _customer_rules(), "customer")


@query
def dq_violations_customers(spark: SparkSession, folder: str) -> DataFrame:
    return dq_violations(_checked_customers(spark, folder), _customer_rules(), "customer")


@query
def dq_violations_orders(spark: SparkSession, folder: str) -> DataFrame:
    return dq_violations(_checked_orders(spark, folder), _order_rules(), "orders")


@query
def null_profile_customers(spark: SparkSession, folder: str) -> DataFrame:
    return null_profile(_checked_customers(spark, folder))


@query
def quarantine_by_rule(spark: SparkSession, folder: str) -> DataFrame:
    rejected = validate(_checked_customers(spark, folder), _customer_rules()).invalid
    return quarantine_report(rejected, "customer")


@query
def dedup_lines(spark: SparkSession, folder: str) -> DataFrame:
    return domain.latest_lines(spark, folder)


@query
def incremental_by_date(spark: SparkSession, folder: str) -> DataFrame:
    """Orders newer than the newest one that was shipped into the target so far."""
    arrived = given(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("_ingest_date")
    )
    return read_incremental(arrived, arrived.where(F.col("_ingest_date") < F.lit(SECOND_CUT)))


@query
def incremental_by_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of the yearly batches that the ledger does not list."""
    arrived = given(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.year("o_orderdate").cast("string").alias("_batch_id")
    )
    ledger = given(spark, folder, "lineitem").where(F.col("l_shipdate") < F.lit(SECOND_CUT))
    return unprocessed_batches(
        arrived, ledger.select(F.year("l_shipdate").cast("string").alias("_batch_id"))
    )


# -- merges and history -----------------------------------------------------------------


def _line_state(
    spark: SparkSession, folder: str, since: dt.date | None, before: dt.date | None
) -> DataFrame:
    """The last shipment of each order line within ``[since, before)``, either end open if None.

    Lines without a date belong to the part that is open at its beginning.
    """
    lines = given(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
        F.col("l_shipdate").cast("date").alias("ship_date"),
    )
    sent = lines.where(domain.within("ship_date", since, before))
    return dedup_latest(sent, ["l_orderkey", "l_linenumber"], ["ship_date"])


@query
def upsert_lines(spark: SparkSession, folder: str) -> DataFrame:
    return merge_upsert(
        _line_state(spark, folder, SECOND_CUT, None),
        _line_state(spark, folder, None, SECOND_CUT),
        ["l_orderkey", "l_linenumber"],
        check_unique=False,
    )


@query
def upsert_lines_replayed(spark: SparkSession, folder: str) -> DataFrame:
    """An older batch replayed over a newer state: only keys the state lacks come in."""
    return merge_upsert(
        _line_state(spark, folder, None, SECOND_CUT),
        _line_state(spark, folder, SECOND_CUT, None),
        ["l_orderkey", "l_linenumber"],
        newer_than="ship_date",
        check_unique=False,
    )


KEY, TRACKED, SK = ["customer_id"], ["country", "segment"], "customer_sk"


def _first_load(spark: SparkSession, folder: str) -> DataFrame:
    state = domain.customer_state(spark, folder, SECOND_CUT, None)
    return scd2_initial(state, KEY, TRACKED, SK, SECOND_CUT, FIRST_CUT)


def _second_batch(spark: SparkSession, folder: str) -> DataFrame:
    return domain.customer_state(spark, folder, None, SECOND_CUT)


def _merged(spark: SparkSession, folder: str) -> DataFrame:
    return scd2_merge(
        _second_batch(spark, folder), _first_load(spark, folder), KEY, TRACKED, SK, LAST_CUT
    )


@query
def history_first_load(spark: SparkSession, folder: str) -> DataFrame:
    return _first_load(spark, folder).drop("_row_hash")


@query
def history_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the second batch that are new or changed."""
    current = current_versions(_first_load(spark, folder))
    return scd2_diff(_second_batch(spark, folder), current, KEY, TRACKED)


@query
def history_merge(spark: SparkSession, folder: str) -> DataFrame:
    return _merged(spark, folder).drop("_row_hash")


@query
def history_merge_repeated(spark: SparkSession, folder: str) -> DataFrame:
    """The second batch applied twice: the repetition changes nothing."""
    once = _merged(spark, folder)
    again = scd2_merge(_second_batch(spark, folder), once, KEY, TRACKED, SK, LAST_CUT)
    return again.drop("_row_hash")


@query
def history_rebuild_customers(spark: SparkSession, folder: str) -> DataFrame:
    return domain.customer_history(spark, folder).drop("_row_hash")


@query
def history_rebuild_dated_back(spark: SparkSession, folder: str) -> DataFrame:
    """As above, with the versions of the first day valid from 1900 on."""
    return domain.customer_history(spark, folder, dt.date(1900, 1, 1)).drop("_row_hash")


@query
def history_rebuild_products(spark: SparkSession, folder: str) -> DataFrame:
    return domain.product_history(spark, folder).drop("_row_hash")


@query
def history_rebuild_events(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's last kind of event per day as a history."""
    feed = given(spark, folder, "events").select(
        "user_id", "event_type", F.col("ts").cast("date").alias("feed_date"), "event_id"
    )
    history = scd2_rebuild(feed, ["user_id"], ["event_type"], "user_sk", "feed_date", ["event_id"])
    return history.drop("_row_hash", "feed_date", "event_id")


@query
def current_customers(spark: SparkSession, folder: str) -> DataFrame:
    history = domain.customer_history(spark, folder)
    return current_versions(history).select(SK, *KEY, *TRACKED, START)


@query
def customer_versions(spark: SparkSession, folder: str) -> DataFrame:
    history = domain.customer_history(spark, folder)
    return version_history(history, KEY).select(*KEY, "version", SK, *TRACKED, START, END)


@query
def surrogate_keys(spark: SparkSession, folder: str) -> DataFrame:
    """All order lines numbered in the order of their columns."""
    lines = domain.latest_lines(spark, folder).select("l_orderkey", "l_linenumber", "l_shipdate")
    return dense_sk(lines, ["l_shipdate", "l_orderkey", "l_linenumber"], "line_sk", start=1)


@query
def customer_row_hash(spark: SparkSession, folder: str) -> DataFrame:
    customers = _checked_customers(spark, folder).select("customer_id", "segment")
    return customers.withColumn("row_hash", row_hash(["customer_id", "segment"]))


# -- joins ------------------------------------------------------------------------------


@query
def point_in_time(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with the customer version of their day, change days included."""
    orders = domain.online_orders(spark, folder).select("order_id", "customer_id", "order_date")
    history = domain.customer_history(spark, folder)
    return pit_join(orders, history, KEY, "order_date", SK)


@query
def point_in_time_asof(spark: SparkSession, folder: str) -> DataFrame:
    """Parts with hundreds of versions each, resolved over distinct (part, day) pairs."""
    sold = domain.sales(spark, folder, F.col, keep=("invoice_id", "stock_code", "sale_date"))
    lines, history = _dims(spark, folder, lambda *_: materialize(sold), PRODUCT_KEYS)  # lines are read twice
    keyed = pit_join(lines, history, ["stock_code"], "sale_date", "product_sk", strategy="asof")
    return _with_text(keyed, "invoice_id", "stock_code")


@query
def point_in_time_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Versions that run 90 days into the next one: every order still meets one version at most."""
    orders = domain.online_orders(spark, folder).select("order_id", "customer_id", "order_date")
    history = domain.customer_history(spark, folder).withColumn(END, F.date_add(F.col(END), 90))
    found = [
        pit_join(orders, history, KEY, "order_date", SK, strategy=s).withColumn("strategy", F.lit(s))
        for s in ("range", "asof")
    ]
    return found[0].unionByName(found[1])


@query
def point_in_time_last_day(spark: SparkSession, folder: str) -> DataFrame:
    """The same versions with their end written as the last valid day."""
    orders = domain.online_orders(spark, folder).select("order_id", "customer_id", "order_date")
    history = domain.customer_history(spark, folder).withColumn(END, F.date_sub(F.col(END), 1))
    return pit_join(orders, history, KEY, "order_date", SK, closed="both")


@query
def store_lookup(spark: SparkSession, folder: str) -> DataFrame:
    lines = domain.sales(spark, folder).select("invoice_id", "stock_code", "store_id")
    return lookup(lines, domain.stores(spark, folder), ["store_id"], ["region", "country"])


@query
def inherited_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Shipments with the customer and day of their order."""
    orders = domain.online_orders(spark, folder)
    shipped = domain.shipping(spark, folder)
    return inherit_keys(shipped, orders, ["order_id"], ["customer_id", "order_date"])


# -- star schema ------------------------------------------------------------------------


def _dims(spark: SparkSession, folder: str, *builders: Query) -> list[DataFrame]:
    """Dimensions that do not depend on each other, built at the same time."""
    return side_by_side(spark, [partial(b, spark, folder) for b in builders], len(builders))


#: Dimensions as facts need them: keys as numbers, and no column that only describes.
CUSTOMER_KEYS = partial(domain.customer_history, keys=F.col, keep=())
CUSTOMER_COUNTRY = partial(domain.customer_history, keys=F.col, keep=("country",))
PRODUCT_KEYS = partial(domain.product_history, keys=F.col, keep=())
STORE_KEYS = partial(domain.store_dim, keys=F.col)


def _with_text(df: DataFrame, *keys: str) -> DataFrame:
    return df.withColumns({k: F.col(k).cast("string") for k in keys})


def _sales_star(
    spark: SparkSession, folder: str, customers: Query = CUSTOMER_KEYS, lines: DataFrame | None = None
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Sales with their keys, and the dimensions by surrogate key; business keys are numbers."""
    customer, product, stores = _dims(spark, folder, customers, PRODUCT_KEYS, STORE_KEYS)
    dims = {"customer_sk": customer, "product_sk": product, "store_sk": stores}
    return star.fact_sales(_sold(spark, folder, customer, lines), customer, product, stores), dims


def _sold(
    spark: SparkSession, folder: str, customer: DataFrame, lines: DataFrame | None = None
) -> DataFrame:
    """Sales with the customer version of their order, which is found before its lines join it."""
    return domain.sales(spark, folder, F.col, partial(star.sale_customer, customer=customer), lines)


def _fact_sales(spark: SparkSession, folder: str, lines: DataFrame | None = None) -> DataFrame:
    return _sales_star(spark, folder, lines=lines)[0]


def _fact_returns(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Returns with their sale's keys, both from lines that are dealt out by order once."""
    lines = domain.lines_by_order(spark, folder)
    back = domain.returns(spark, folder, F.col, lines)
    return _with_text(star.fact_returns(back, _fact_sales(spark, folder, lines), **options), "original_invoice_id")


@query
def dim_date(spark: SparkSession, folder: str) -> DataFrame:
    """The calendar over the order dates of the data."""
    first, last = (
        given(spark, folder, "orders")
        .agg(F.min("o_orderdate").cast("date"), F.max("o_orderdate").cast("date"))
        .first()
    )
    return star.dim_date(spark, first, last)


@query
def dim_customer(spark: SparkSession, folder: str) -> DataFrame:
    return star.dim_customer(domain.customer_history(spark, folder)).drop("_row_hash")


@query
def dim_product(spark: SparkSession, folder: str) -> DataFrame:
    part = given(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("stock_code"), F.col("p_name").alias("description")
    )
    history = domain.product_history(spark, folder).drop("_row_hash")
    return star.dim_product(lookup(history, part, ["stock_code"], ["description"]))


@query
def dim_store(spark: SparkSession, folder: str) -> DataFrame:
    return star.dim_store(domain.stores(spark, folder))


@query
def dim_supplier(spark: SparkSession, folder: str) -> DataFrame:
    return star.dim_supplier(domain.suppliers(spark, folder))


@query
def fact_sales(spark: SparkSession, folder: str) -> DataFrame:
    return _with_text(_fact_sales(spark, folder), "invoice_id", "stock_code")


@query
def fact_sales_store_id(spark: SparkSession, folder: str) -> DataFrame:
    """The same fact over a store dimension that has no surrogate key."""
    dims = _dims(spark, folder, CUSTOMER_KEYS, PRODUCT_KEYS, partial(domain.stores, keys=F.col))
    sold = star.fact_sales(_sold(spark, folder, dims[0]), *dims)
    return _with_text(sold, "invoice_id", "stock_code", "store_id")


@query
def fact_returns(spark: SparkSession, folder: str) -> DataFrame:
    return _fact_returns(spark, folder)


@query
def fact_returns_invoice_only(spark: SparkSession, folder: str) -> DataFrame:
    return _fact_returns(spark, folder, on_stock_code=False)


def _fact_orders(spark: SparkSession, folder: str) -> DataFrame:
    dims = _dims(spark, folder, CUSTOMER_KEYS, PRODUCT_KEYS)
    return star.fact_online_orders(domain.online_orders(spark, folder, F.col), *dims)


@query
def fact_online_orders(spark: SparkSession, folder: str) -> DataFrame:
    return _with_text(_fact_orders(spark, folder), "order_id")


@query
def fact_shipping(spark: SparkSession, folder: str) -> DataFrame:
    orders = _with_text(_fact_orders(spark, folder), "order_id")
    return star.fact_shipping(domain.shipping(spark, folder), orders)


def _fact_inventory(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    product, stores = _dims(spark, folder, PRODUCT_KEYS, STORE_KEYS)
    levels = domain.inventory(spark, folder, F.col)
    return star.fact_inventory_snapshot(levels, product, stores), product


@query
def fact_inventory_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return _fact_inventory(spark, folder)[0]


@query
def bridge_promotions(spark: SparkSession, folder: str) -> DataFrame:
    return star.bridge_promotions(
        domain.promotions(spark, folder), domain.product_history(spark, folder)
    )


@query
def promotions_at_sale(spark: SparkSession, folder: str) -> DataFrame:
    """Sales with the best of the overlapping offers for their part on the day of sale."""
    sold = domain.sales(spark, folder, F.col, keep=("invoice_id", "stock_code", "sale_date"))
    sold = materialize(sold)  # read three times
    live = star.sales_promotions(sold, domain.offers(spark, folder, F.col))
    return _with_text(live, "invoice_id", "stock_code")


@query
def foreign_keys(spark: SparkSession, folder: str) -> DataFrame:
    """All four keys of the sales fact: customer, product, store and day."""
    sold, dims = _sales_star(spark, folder)
    return fk_audit(sold, "fact_sales", {**dims, "date_sk": dim_date(spark, folder)})


# -- analyst queries --------------------------------------------------------------------


@query
def revenue_by_country(spark: SparkSession, folder: str) -> DataFrame:
    sold, dims = _sales_star(spark, folder, CUSTOMER_COUNTRY)
    return analytics.revenue_by_country(sold, dims["customer_sk"])


@query
def top_customers(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.top_customers(_fact_sales(spark, folder))


@query
def return_rate(spark: SparkSession, folder: str) -> DataFrame:
    needed = ["invoice_id", "stock_code", "customer_sk", "product_sk", "quantity"]
    sold = materialize(_fact_sales(spark, folder).select(*needed))  # read twice
    return analytics.return_rate(sold, star.fact_returns(domain.returns(spark, folder, F.col), sold))


@query
def latest_stock(spark: SparkSession, folder: str) -> DataFrame:
    return _with_text(analytics.latest_stock(*_fact_inventory(spark, folder)), "stock_code")


@query
def preview_orders(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.preview(_checked_orders(spark, folder), ["order_date", "order_id"], 10)


# -- layers on storage ------------------------------------------------------------------


def _spec(name: str, types: str, key: list[str], **options) -> TableSpec:
    columns = [dict(zip(("name", "type"), c.split(":"))) for c in types.split()]
    return TableSpec(name, tuple(columns), tuple(key), **options)


SALES = _spec(
    "sales",
    "invoice_id:string stock_code:string quantity:integer unit_price:double customer_id:string "
    "store_id:string invoice_date:timestamp sale_date:date",
    ["invoice_id", "stock_code"],
    dq_rules=({"type": "not_null", "column": "invoice_id"},
              {"type": "non_negative", "column": "quantity"}),
)
CUSTOMER = _spec(
    "customer",
    "customer_id:string country:string segment:string",
    ["customer_id"],
    scd_type=2,
    tracked_columns=("country", "segment"),
    surrogate_key_col="customer_sk",
    dq_rules=({"type": "not_null", "column": "customer_id"},),
)
PRODUCT = _spec(
    "product",
    "stock_code:string description:string unit_price:double supplier_id:string",
    ["stock_code"],
    scd_type=2,
    tracked_columns=("unit_price",),
    surrogate_key_col="product_sk",
    dq_rules=({"type": "non_negative", "column": "unit_price"},),
)
STORE = _spec(
    "store", "store_id:string region:string country:string store_name:string", ["store_id"]
)
ORDERS = _spec(
    "online_orders",
    "order_id:string customer_id:string stock_code:string order_status:string order_date:date",
    ["order_id"],
    dq_rules=({"type": "allowed_values", "column": "order_status", "allowed": ["F", "O"]},),
)


def _part_prices(spark: SparkSession, folder: str) -> DataFrame:
    return given(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("stock_code"),
        F.col("p_name").alias("description"),
        F.col("p_retailprice").alias("unit_price"),
        F.col("p_brand").alias("supplier_id"),
    )


@query
def landing_to_star(spark: SparkSession, folder: str) -> DataFrame:
    """CSV files through bronze, silver and gold; two customer batches, then fact_sales."""
    tables = Tables(spark, _folder(spark))
    landing = f"{tables.root}/landing"
    specs = [SALES, CUSTOMER, PRODUCT, STORE]
    export_landing(domain.sales(spark, folder), f"{landing}/sales")
    export_landing(
        domain.customer_state(spark, folder, SECOND_CUT, None), f"{landing}/customer/1"
    )
    export_landing(_part_prices(spark, folder), f"{landing}/product")
    export_landing(domain.stores(spark, folder), f"{landing}/store")
    layers.run_bronze(tables, specs, landing, SECOND_CUT, at_once=4)
    layers.run_silver(tables, specs, SECOND_CUT, initial_start=FIRST_CUT, at_once=4)
    export_landing(_second_batch(spark, folder), f"{landing}/customer/2")
    layers.run_bronze(tables, [CUSTOMER], landing, SECOND_CUT + dt.timedelta(days=1))
    layers.run_silver(tables, specs, SECOND_CUT + dt.timedelta(days=1), at_once=4)
    names = ["dim_customer", "dim_product", "dim_store", "fact_sales"]
    layers.run_gold(tables, names, partitions={})  # some 25 rows a day are no partition
    return tables.read("gold", "fact_sales")


def _retail_landing(
    spark: SparkSession, folder: str, latest: DataFrame | None = None
) -> dict[str, DataFrame]:
    """The given tables in the columns of the ten retail specifications.

    Sales name one of the allowed countries for the region of their customer; there is none for
    the Middle East, so the sales of that region are rejected. The region is found once an order,
    before its lines join it. ``latest`` are the ``latest_lines``, if shipments and returns are to
    read the same ones.
    """
    regions = (
        given(spark, folder, "customer")
        .join(given(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(given(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("c_custkey").cast("string").alias("customer_id"), F.col("r_name").alias("region"))
    )
    country = F.coalesce(
        *[F.when(F.col("region") == r, F.lit(c)) for r, c in REGION_COUNTRY.items()], F.col("region")
    )
    lines = domain.sales(spark, folder, headers=lambda orders: orders.join(regions, "customer_id", "left"))
    landed = {
        "sales": lines.withColumn("country", country),
        "customer": domain.customer_state(spark, folder, None, None),
        "product": _part_prices(spark, folder),
        "store": domain.stores(spark, folder),
        "supplier": domain.suppliers(spark, folder),
        "inventory": domain.inventory(spark, folder),
        "promotions": domain.promotions(spark, folder),
        "online_orders": domain.online_orders(spark, folder),
        "shipping": domain.shipping(spark, folder, latest),
        "returns": domain.returns(spark, folder, latest=latest),
    }
    specs = retail_specs()
    return {name: df.select([c["name"] for c in specs[name].columns]) for name, df in landed.items()}


def _land_retail(spark: SparkSession, folder: str, landing: str) -> None:
    """Landing files of all ten tables; shipments and returns come from the same latest lines."""
    with temporary_steps(spark):
        with shuffles_freed(spark):
            latest = materialize(domain.latest_lines(spark, folder).drop("l_suppkey", "l_extendedprice"))
        for name, df in _retail_landing(spark, folder, latest).items():
            export_landing(df, f"{landing}/{name}")


REGION_COUNTRY = {
    "EUROPE": "United Kingdom", "AMERICA": "USA", "ASIA": "Australia", "AFRICA": "France",
}


def _digest(tables: Tables, name: str) -> DataFrame:
    """Rows of a gold table, sums of its resolved keys, and its quantity."""
    rows = tables.read("gold", name)
    amount = next((c for c in ("quantity", "stock_on_hand") if c in rows.columns), "")

    def total(column: str, name: str):
        found = F.sum(F.col(column).cast("bigint")) if column in rows.columns else F.lit(None)
        return F.coalesce(found, F.lit(0)).cast("bigint").alias(name)

    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        total("customer_sk", "customer_keys"),
        total("product_sk", "product_keys"),
        total("store_sk", "store_keys"),
        total(amount, "amount"),
    ).select(F.lit(name).alias("table_name"), "*")


@query
def gold_star(spark: SparkSession, folder: str) -> DataFrame:
    """All eleven gold tables from the retail specifications: a digest of each.

    Tables that are partitioned by their date have a directory a month.
    """
    tables = Tables(spark, _folder(spark))
    specs = [
        replace(spec, partition_period="month") if spec.partition_by else spec
        for spec in retail_specs().values()
    ]
    _land_retail(spark, folder, f"{tables.root}/landing")
    layers.run_bronze(tables, specs, f"{tables.root}/landing", LAST_CUT, at_once=4)
    layers.run_silver(tables, specs, LAST_CUT, initial_start=FIRST_CUT, at_once=4)
    layers.run_gold(tables, period="month", at_once=4)
    return reduce(DataFrame.unionByName, [_digest(tables, name) for name in layers.GOLD_INPUTS])


@query
def gold_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Partitioned and clustered fact_sales, brought up to date after a second customer batch.

    With some 25 sales a day a directory holds a month.
    """
    tables = Tables(spark, _folder(spark))
    specs, landing = retail_specs(), f"{tables.root}/landing"
    specs["sales"] = replace(specs["sales"], partition_period="month")
    landed = _retail_landing(spark, folder)
    landed["customer"] = domain.customer_state(spark, folder, SECOND_CUT, None)
    chosen = ["sales", "customer", "product", "store"]
    for name in chosen:
        export_landing(landed[name], f"{landing}/{name}/1")
    names = ["dim_customer", "dim_product", "dim_store", "fact_sales"]
    first = [specs[name] for name in chosen]
    layers.run_bronze(tables, first, landing, SECOND_CUT, at_once=4)
    layers.run_silver(tables, first, SECOND_CUT, initial_start=FIRST_CUT, at_once=4)
    layers.run_gold(tables, names, period="month", at_once=4)
    export_landing(_second_batch(spark, folder), f"{landing}/customer/2")
    following = SECOND_CUT + dt.timedelta(days=1)
    layers.run_bronze(tables, [specs["customer"]], landing, following)
    layers.run_silver(tables, [specs["customer"]], following)
    layers.run_gold(tables, names, incremental=True, period="month", at_once=4)
    return tables.read("gold", "fact_sales").drop("_month")


@query
def bronze_and_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """Both sides of a landing ingest, written in one pass."""
    tables = Tables(spark, _folder(spark))
    export_landing(domain.online_orders(spark, folder), f"{tables.root}/landing")
    layers.ingest_bronze(tables, ORDERS, f"{tables.root}/landing", RULES_AS_OF)
    columns = ["order_id", "order_status", "order_date", "_ingest_date"]
    stored = tables.read("bronze", ORDERS.name).select(*columns, F.lit("").alias("failed_rules"))
    rejected = _readable(tables.read("quarantine", ORDERS.name))
    return stored.unionByName(rejected.select(*columns, "failed_rules"))


@query
def run_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of a bronze, silver and gold run, collected by the writes themselves."""
    tables = Tables(spark, _folder(spark))
    export_landing(domain.online_orders(spark, folder), f"{tables.root}/landing/online_orders")
    steps = [
        *layers.run_bronze(tables, [ORDERS], f"{tables.root}/landing", RULES_AS_OF).values(),
        *layers.run_silver(tables, [ORDERS], RULES_AS_OF).values(),
        *layers.run_silver(tables, [ORDERS], RULES_AS_OF).values(),
        *layers.run_gold(tables, ["dim_store", "dim_date"]).values(),
    ]
    return layers.run_metrics(tables, steps)


@query
def silver_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """Orders that bronze takes without rules; silver checks them and keeps the rejects apart."""
    tables = Tables(spark, _folder(spark))
    export_landing(domain.online_orders(spark, folder), f"{tables.root}/landing/online_orders")
    layers.run_bronze(tables, [replace(ORDERS, dq_rules=())], f"{tables.root}/landing", RULES_AS_OF)
    layers.run_silver(tables, [ORDERS], RULES_AS_OF)
    columns = ["order_id", "order_status", "order_date"]
    kept = tables.read("silver", ORDERS.name).select(*columns, F.lit("").alias("failed_rules"))
    rejected = _readable(tables.read("quarantine", f"{ORDERS.name}_silver"))
    return kept.unionByName(rejected.select(*columns, "failed_rules"))


@query
def deleted_day_then_new_day(spark: SparkSession, folder: str) -> DataFrame:
    """Three ingest days; the second is dropped from bronze and pruned before the third arrives.

    Silver has seen the second day and keeps it, and must not take the third for it.
    """
    tables = Tables(spark, _folder(spark))
    landing = f"{tables.root}/landing"
    orders = domain.online_orders(spark, folder)
    cuts = [(None, SECOND_CUT), (SECOND_CUT, THIRD_CUT), (THIRD_CUT, None)]
    days = [SECOND_CUT, THIRD_CUT, LAST_CUT]
    for day, (since, before) in zip(days, cuts, strict=True):
        if day == LAST_CUT:
            tables.replace_partition(None, "bronze", ORDERS.name, "_ingest_date", THIRD_CUT)
            tables.prune("bronze", ORDERS.name)
        part = orders.where(domain.within("order_date", since, before))
        export_landing(part, f"{landing}/online_orders/{day}")
        layers.run_bronze(tables, [ORDERS], landing, day)
        layers.run_silver(tables, [ORDERS], day)
    columns = [c["name"] for c in ORDERS.columns]
    kept = tables.read("silver", ORDERS.name).select(*columns, F.lit("silver").alias("layer"))
    stored = tables.read("bronze", ORDERS.name).select(*columns, F.lit("bronze").alias("layer"))
    return kept.unionByName(stored)


@query
def silver_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Two landing batches of shipments upserted into a silver table partitioned by line number."""
    tables = Tables(spark, _folder(spark))
    spec = _spec(
        "lines",
        "l_orderkey:string l_linenumber:integer l_partkey:string l_quantity:double "
        "l_extendedprice:double ship_date:date",
        ["l_orderkey", "l_linenumber"],
        partition_by=("l_linenumber",),
    )
    parts = [(None, SECOND_CUT, SECOND_CUT), (SECOND_CUT, None, LAST_CUT)]
    for number, (since, before, day) in enumerate(parts):
        export_landing(
            _line_state(spark, folder, since, before), f"{tables.root}/landing/lines/{number}"
        )
        layers.run_bronze(tables, [spec], f"{tables.root}/landing", day)
        layers.run_silver(tables, [spec], day)
    return tables.read("silver", "lines").select([c["name"] for c in spec.columns])


@query
def reprocessed_day(spark: SparkSession, folder: str) -> DataFrame:
    """An ingest day dropped from bronze and read again a day later."""
    tables = Tables(spark, _folder(spark))
    landing = f"{tables.root}/landing"
    first, second = RULES_AS_OF, RULES_AS_OF + dt.timedelta(days=1)
    export_landing(domain.online_orders(spark, folder), f"{landing}/online_orders/1")
    layers.run_bronze(tables, [ORDERS], landing, first)
    layers.run_silver(tables, [ORDERS], first)
    layers.reprocess(tables, [ORDERS], landing, [first], as_of=second)
    columns = [c["name"] for c in ORDERS.columns]
    kept = tables.read("silver", ORDERS.name).select(*columns, F.lit("silver").alias("layer"))
    stored = tables.read("bronze", ORDERS.name).select(*columns, F.lit("bronze").alias("layer"))
    return kept.unionByName(stored)


@query
def reprocessed_history(spark: SparkSession, folder: str) -> DataFrame:
    """Three ingest days of customers, the middle one landed again with rows changed and removed.

    Day by day: the customers' last reports before a cut, between two cuts, and after. The
    corrected middle day lacks every third customer and moves every fifth to another segment.
    """
    tables = Tables(spark, _folder(spark))
    landing = f"{tables.root}/landing"
    for day, part in _three_days(spark, folder):
        export_landing(part, f"{landing}/customer/{day}")
        layers.run_bronze(tables, [CUSTOMER], landing, day)
        layers.run_silver(tables, [CUSTOMER], day)
    _correct_middle_day(spark, folder, tables, [CUSTOMER])
    return tables.read("silver", "customer").select(*KEY, *TRACKED, START, END, "is_current")


def _correct_middle_day(spark: SparkSession, folder: str, tables: Tables, specs: list[TableSpec]) -> None:
    """The middle day of the customers lands again: every third is missing, every fifth has moved."""
    middle, part = _three_days(spark, folder)[1]
    number = F.col("customer_id").cast("bigint")
    moved = F.when(number % 5 == 0, F.lit("MOVED")).otherwise(F.col("segment"))
    corrected = part.where(number % 3 != 0).withColumn("segment", moved)
    export_landing(corrected, f"{tables.root}/corrected/customer")
    layers.reprocess(
        tables, specs, f"{tables.root}/landing", [middle],
        relanded={middle: f"{tables.root}/corrected"},
    )


@query
def gold_after_correction(spark: SparkSession, folder: str) -> DataFrame:
    """Sales by month, brought up to date after a middle day of the customers was corrected.

    Each sale with the customer version it holds, by the version's own columns. Bronze and silver
    run once more after the correction and must find nothing new.
    """
    tables = Tables(spark, _folder(spark))
    specs, landing = retail_specs(), f"{tables.root}/landing"
    sales = replace(specs["sales"], partition_period="month")
    landed = _retail_landing(spark, folder)
    for name in ("sales", "product", "store"):
        export_landing(landed[name], f"{landing}/{name}")
    others, customer = [sales, specs["product"], specs["store"]], [specs["customer"]]
    layers.run_bronze(tables, others, landing, SECOND_CUT, at_once=4)
    layers.run_silver(tables, others, SECOND_CUT, at_once=4)
    for day, part in _three_days(spark, folder):
        export_landing(part, f"{landing}/customer/{day}")
        layers.run_bronze(tables, customer, landing, day)
        layers.run_silver(tables, customer, day)
    names = ["dim_customer", "dim_product", "dim_store", "fact_sales"]
    layers.run_gold(tables, names, period="month", at_once=4)
    _correct_middle_day(spark, folder, tables, customer)
    layers.run_bronze(tables, customer, landing, LAST_CUT)
    layers.run_silver(tables, customer, LAST_CUT)
    layers.run_gold(tables, names, incremental=True, period="month", at_once=4)
    sold = tables.read("gold", "fact_sales").select("invoice_id", "stock_code", "sale_date", SK)
    versions = tables.read("gold", "dim_customer").select(SK, *KEY, *TRACKED, START)
    return sold.join(versions, SK, "left").drop(SK)


@query
def removed_version_then_new(spark: SparkSession, folder: str) -> DataFrame:
    """A corrected day removes versions, the next day opens others; no number is given twice.

    Each version of the customers with how many versions ever had its surrogate key.
    """
    tables = Tables(spark, _folder(spark))
    landing, days = f"{tables.root}/landing", _three_days(spark, folder)
    given_out = []

    def note() -> None:
        given_out.append(tables.read("silver", "customer").select(SK, *KEY, START))

    for day, part in days[:2]:
        export_landing(part, f"{landing}/customer/{day}")
        layers.run_bronze(tables, [CUSTOMER], landing, day)
        layers.run_silver(tables, [CUSTOMER], day)
    note()
    _correct_middle_day(spark, folder, tables, [CUSTOMER])
    note()
    day, part = days[2]
    export_landing(part, f"{landing}/customer/{day}")
    layers.run_bronze(tables, [CUSTOMER], landing, day)
    layers.run_silver(tables, [CUSTOMER], day)
    note()
    ever = reduce(DataFrame.unionByName, given_out).distinct()
    owners = ever.groupBy(SK).agg(F.count("*").alias("owners"))
    now = tables.read("silver", "customer").select(SK, *KEY, *TRACKED, START, END, "is_current")
    return now.join(owners, SK).drop(SK)


@query
def relanded_then_next_day(spark: SparkSession, folder: str) -> DataFrame:
    """Bronze after a day was delivered anew and the next day arrived: superseded files stay out."""
    tables = Tables(spark, _folder(spark))
    landing, days = f"{tables.root}/landing", _three_days(spark, folder)
    for day, part in days[:2]:
        export_landing(part, f"{landing}/customer/{day}")
        layers.run_bronze(tables, [CUSTOMER], landing, day)
    layers.run_silver(tables, [CUSTOMER], days[1][0])
    _correct_middle_day(spark, folder, tables, [CUSTOMER])
    # Reprocessed once more, the day has the files of its second delivery.
    layers.reprocess(tables, [CUSTOMER], landing, [days[1][0]])
    day, part = days[2]
    export_landing(part, f"{landing}/customer/{day}")
    layers.run_bronze(tables, [CUSTOMER], landing, day)
    return tables.read("bronze", "customer").select(*KEY, *TRACKED, "_ingest_date")


@query
def late_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Three daily batches of customers that arrive in the order third, first, second."""
    tables = Tables(spark, _folder(spark))
    days = _three_days(spark, folder)
    for day, part in (days[2], days[0], days[1]):
        export_landing(part, f"{tables.root}/landing/customer/{day}")
        layers.run_bronze(tables, [CUSTOMER], f"{tables.root}/landing", day)
        layers.run_silver(tables, [CUSTOMER], day)
    return tables.read("silver", "customer").select(*KEY, *TRACKED, START, END, "is_current")


@query
def held_batch(spark: SparkSession, folder: str) -> DataFrame:
    """A second batch of customers with too many NULLs is written, audited and held back whole."""
    tables = Tables(spark, _folder(spark))
    landing, days = f"{tables.root}/landing", _three_days(spark, folder)[:2]
    for number, (day, part) in enumerate(days):
        if number:
            part = part.withColumn("segment", F.nullif("segment", F.lit("1-URGENT")))
        export_landing(part, f"{landing}/customer/{day}")
        result = layers.run_bronze(tables, [CUSTOMER], landing, day, gate=Gate())["customer"]
    columns = [*KEY, *TRACKED, "_ingest_date"]
    stored = tables.read("bronze", "customer").select(*columns, F.lit("bronze").alias("layer"), F.lit("").alias("fault"))
    held = tables.read("held", "customer").select(
        *columns, F.lit("held").alias("layer"), F.lit(result["skipped"]).alias("fault")
    )
    return stored.unionByName(held)


@query
def replayed_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """Rejected orders come back under changed rules, in two replays of which the second finds none."""
    tables = Tables(spark, _folder(spark))
    export_landing(domain.online_orders(spark, folder), f"{tables.root}/landing/online_orders")
    layers.run_bronze(tables, [ORDERS], f"{tables.root}/landing", RULES_AS_OF)
    layers.run_silver(tables, [replace(ORDERS, dq_rules=())], RULES_AS_OF)
    changed = replace(
        ORDERS,
        dq_rules=({"type": "allowed_values", "column": "order_status", "allowed": ["F", "O", "P"]},
                  {"type": "no_future_date", "column": "order_date"}),
    )
    for _ in range(2):
        layers.replay_quarantine(tables, changed, RULES_AS_OF)
    layers.run_silver(tables, [replace(ORDERS, dq_rules=())], RULES_AS_OF)
    columns = ["order_id", "order_status", "order_date"]
    sides = [
        tables.read(layer, ORDERS.name).select(*columns, F.lit(layer).alias("layer"), F.lit("").alias("failed_rules"))
        for layer in ("bronze", "silver")
    ]
    left = _readable(tables.read("quarantine", ORDERS.name))
    left = left.select(*columns, F.lit("quarantine").alias("layer"), "failed_rules")
    return sides[0].unionByName(sides[1]).unionByName(left)


@query
def repaired_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Sales of customers that arrive after them, dated back: their keys, and which months changed."""
    tables = Tables(spark, _folder(spark))
    specs, landing = retail_specs(), f"{tables.root}/landing"
    chosen = [replace(specs["sales"], partition_period="month"), *(specs[n] for n in ("customer", "product", "store"))]
    landed = _retail_landing(spark, folder)
    late = F.col("customer_id").cast("bigint") % 500 == 7
    for name in ("sales", "product", "store"):
        export_landing(landed[name], f"{landing}/{name}")
    export_landing(landed["customer"].where(~late), f"{landing}/customer/1")
    layers.run_bronze(tables, chosen, landing, SECOND_CUT, at_once=4)
    layers.run_silver(tables, chosen, SECOND_CUT, initial_start=FIRST_CUT, at_once=4)
    names = ["dim_customer", "dim_product", "dim_store", "fact_sales"]
    layers.run_gold(tables, names, period="month", at_once=4)
    before = tables.generations("gold", "fact_sales")
    export_landing(landed["customer"].where(late), f"{landing}/customer/2")
    layers.run_bronze(tables, [specs["customer"]], landing, FIRST_CUT)
    layers.run_silver(tables, [specs["customer"]], FIRST_CUT)
    layers.run_gold(tables, names, incremental=True, period="month", at_once=4)
    sold = tables.read("gold", "fact_sales", with_directory=True).select(
        "invoice_id", "stock_code", "sale_date", SK,
        (~F.split("_directory", "/")[0].isin(before)).alias("rewritten"),
    )
    versions = tables.read("gold", "dim_customer").select(SK, *KEY, *TRACKED, START)
    return sold.join(versions, SK, "left").drop(SK)


THIRD_CUT = dt.date(2000, 7, 1)


def _three_days(spark: SparkSession, folder: str) -> list[tuple[dt.date, DataFrame]]:
    cuts = [(None, SECOND_CUT), (SECOND_CUT, THIRD_CUT), (THIRD_CUT, None)]
    days = [SECOND_CUT, THIRD_CUT, LAST_CUT]
    return [
        (day, domain.customer_state(spark, folder, before, since))
        for day, (since, before) in zip(days, cuts, strict=True)
    ]


@query
def silver_catch_up(spark: SparkSession, folder: str) -> DataFrame:
    """Three ingest days of customers in bronze, refined in one run."""
    tables = Tables(spark, _folder(spark))
    for day, part in _three_days(spark, folder):
        export_landing(part, f"{tables.root}/landing/customer/{day}")
        layers.run_bronze(tables, [CUSTOMER], f"{tables.root}/landing", day)
    layers.run_silver(tables, [CUSTOMER], LAST_CUT)
    return tables.read("silver", "customer").select(*KEY, *TRACKED, START, END, "is_current")


@query
def clustered_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Sales written clustered by customer and part within their year, and read back."""
    tables = Tables(spark, _folder(spark))
    lines = domain.sales(spark, folder).select(
        F.col("customer_id").cast("bigint").alias("customer_key"),
        F.col("stock_code").cast("bigint").alias("part_key"),
        F.year("sale_date").alias("sale_year"),
        date_key(F.col("sale_date")).alias("date_sk"),
        "invoice_id",
        "quantity",
    )
    layers.write_clustered(
        tables, lines, "gold", "sales", ["customer_key", "part_key"], ["sale_year"]
    )
    return tables.read("gold", "sales")


@query
def clustered_order(spark: SparkSession, folder: str) -> DataFrame:
    """Clustering in memory keeps every row as it is."""
    orders = given(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return cluster(orders, ["o_custkey", "o_totalprice"])


@query
def clustered_skewed(spark: SparkSession, folder: str) -> DataFrame:
    """Orders clustered on two skewed columns, by quantiles and linearly: do files cover less then?

    Each layout is written and read back, and the share of the rows that lie between a file's least
    and greatest value is averaged over its files, per column.
    """
    tables = Tables(spark, _folder(spark))
    skewed = given(spark, folder, "orders").select(
        "o_orderkey",
        F.pow(F.col("o_custkey").cast("double"), 6).alias("a"),
        F.exp(F.col("o_totalprice") / 20000).alias("b"),
    )
    covered = []
    for scale in ("linear", "rank"):
        layers.write_clustered(tables, skewed, "gold", scale, ["a", "b"], partitions=16, scale=scale)
        rows = tables.read("gold", scale)
        cuts = rows.agg(*[F.percentile_approx(c, [i / 100 for i in range(101)], 10_000).alias(c) for c in "ab"]).first()
        files = tables.spark.read.parquet(*_paths(tables, scale)).groupBy(F.col("_metadata.file_path")).agg(
            *[f(c).alias(f"{n}_{c}") for c in "ab" for n, f in (("lo", F.min), ("hi", F.max))]
        )
        share = _between(cuts["a"], "a") + _between(cuts["b"], "b")
        covered.append(files.agg(F.avg(share)).first()[0])
    tighter = F.lit(covered[1] < covered[0])
    return tables.read("gold", "rank").agg(F.count("*").alias("n_rows")).withColumn("tighter", tighter)


def _between(cuts: list[float], column: str):
    """How many of the cuts lie within a file's values."""
    low, high = F.col(f"lo_{column}"), F.col(f"hi_{column}")
    return F.size(F.filter(F.lit(cuts), lambda v: (v >= low) & (v <= high)))


def _paths(tables: Tables, name: str) -> list[str]:
    state = tables.published("gold", name)
    return state.paths(list(state.dirs))


@query
def catalog_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Tables by name: published, appended to, one date replaced, published again."""
    tables = CatalogTables(spark, f"strata_{uuid.uuid4().hex[:12]}_")
    tables.init(["silver"])
    orders = _checked_orders(spark, folder)
    earlier = orders.where(F.col("order_date") < F.lit(SECOND_CUT))
    later = orders.where(F.col("order_date") >= F.lit(SECOND_CUT))
    tables.publish(earlier, "silver", "orders")
    tables.append(later, "silver", "orders")
    open_orders = tables.read("silver", "orders").where("order_status <> 'F'")
    tables.publish(open_orders, "silver", "orders")
    tables.replace_partition(None, "silver", "orders", "order_date", SECOND_CUT)
    found = materialize(tables.read("silver", "orders"))
    tables.drop("silver")
    return found


def _checksum(rows: DataFrame, name: str) -> DataFrame:
    """Rows of a table and the sum of a 60-bit hash of each, over all columns but helpers."""
    columns = sorted(c for c in rows.columns if not c.startswith("_"))

    def text(column: str):
        value = F.col(column)
        if rows.schema[column].dataType == T.DoubleType():
            value = F.floor(value * 1000)
        return F.coalesce(value.cast("string"), F.lit("~"))

    digest = F.conv(F.substring(F.md5(F.concat_ws("|", *map(text, columns))), 1, 15), 16, 10)
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(digest.cast("decimal(20,0)")).cast("string").alias("checksum"),
    ).select(F.lit(name).alias("table_name"), F.lit(",".join(columns)).alias("columns"), "*")


@query
def catalog_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """Bronze, silver and all gold tables by catalog name: every row and column of gold, by checksum."""
    tables = NamedTables(spark, _folder(spark), f"strata_{uuid.uuid4().hex[:12]}_")
    tables.init()
    specs = [
        replace(spec, partition_period="month") if spec.partition_by else spec
        for spec in retail_specs().values()
    ]
    _land_retail(spark, folder, f"{tables.root}/landing")
    layers.run_bronze(tables, specs, f"{tables.root}/landing", LAST_CUT, at_once=4)
    layers.run_silver(tables, specs, LAST_CUT, initial_start=FIRST_CUT, at_once=4)
    layers.run_gold(tables, period="month", at_once=4)
    found = [_checksum(tables.by_name("gold", name), name) for name in layers.GOLD_INPUTS]
    sums = materialize(reduce(DataFrame.unionByName, found))
    tables.detach()
    return sums


@query
def stream_bronze(spark: SparkSession, folder: str) -> DataFrame:
    """The landing folder read as a stream into bronze and silver."""
    tables = Tables(spark, _folder(spark))
    landing = f"{tables.root}/landing"
    export_landing(domain.online_orders(spark, folder), landing)
    for _ in range(2):  # the second start finds nothing new
        stream_ingest(
            tables, ORDERS, landing, f"{tables.root}/stream", RULES_AS_OF
        ).awaitTermination()
    return tables.read("silver", ORDERS.name).select([c["name"] for c in ORDERS.columns])


#: Sales lines in a landing file: what one task reads and writes, however large the tables are.
LINES_A_FILE = 2_000_000


def _sales_files(lines: int) -> int:
    """How many landing files at most; an even number, for two micro-batches of half of them."""
    return 2 * max(1, -(-lines // (2 * LINES_A_FILE)))


@query
def stream_gold(spark: SparkSession, folder: str) -> DataFrame:
    """Sales and later reports of the customers streamed from landing files to fact_sales."""
    tables = Tables(spark, _folder(spark))
    specs, landing = retail_specs(), f"{tables.root}/landing"
    sales = replace(specs["sales"], partition_period="month")
    landed = _retail_landing(spark, folder)
    landed["customer"] = domain.customer_state(spark, folder, SECOND_CUT, None)
    others = [specs["customer"], specs["product"], specs["store"]]
    for spec in others:
        export_landing(landed[spec.name], f"{landing}/{spec.name}/1")
    layers.run_bronze(tables, others, landing, SECOND_CUT, at_once=4)
    layers.run_silver(tables, others, SECOND_CUT, initial_start=FIRST_CUT, at_once=4)
    names = ["dim_customer", "dim_product", "dim_store", "fact_sales"]
    files = _sales_files(given(spark, folder, "lineitem").count())
    export_landing(landed["sales"].coalesce(files), f"{landing}/sales")
    export_landing(_second_batch(spark, folder), f"{landing}/customer/2")
    following = SECOND_CUT + dt.timedelta(days=1)
    # Half of the sales in each micro-batch; then a stream of the customers; then nothing new.
    for spec, source, day, most in (
        (sales, "sales", SECOND_CUT, files // 2),
        (specs["customer"], "customer/2", following, None),
        (sales, "sales", following, files // 2),
    ):
        stream_ingest(
            tables, spec, f"{landing}/{source}", f"{tables.root}/stream/{spec.name}", day,
            gold=names, period="month", files_at_once=most,
        ).awaitTermination()
    return tables.read("gold", "fact_sales").drop("_month")


@query
def stream_two_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Two landing folders streamed into one table, each with a checkpoint of its own."""
    tables = Tables(spark, _folder(spark))
    orders = domain.online_orders(spark, folder)
    for number, (since, before) in enumerate([(None, SECOND_CUT), (SECOND_CUT, None)]):
        landing = f"{tables.root}/landing/{number}"
        export_landing(orders.where(domain.within("order_date", since, before)), landing)
        checkpoint = f"{tables.root}/stream/{number}"
        stream_ingest(tables, ORDERS, landing, checkpoint, RULES_AS_OF).awaitTermination()
    return tables.read("silver", ORDERS.name).select([c["name"] for c in ORDERS.columns])
