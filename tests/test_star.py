import datetime as dt

import pytest
from rows import as_rows

from strata.functions.columns import interleave_bits
from strata.plans import analytics, star


def test_calendar(spark):
    year = star.dim_date(spark)
    assert year.count() == 365
    rows = {r.date_sk: r for r in year.collect()}
    day = rows[20260704]
    assert (day.full_date, day.year, day.month, day.day, day.quarter) == (
        dt.date(2026, 7, 4), 2026, 7, 4, 3,
    )
    assert (day.day_name, day.month_name, day.is_weekend) == ("Saturday", "July", True)
    for r in rows.values():
        assert r.date_sk == int(r.full_date.strftime("%Y%m%d"))
        assert r.day_name == r.full_date.strftime("%A")
        assert r.month_name == r.full_date.strftime("%B")
        assert r.is_weekend == (r.full_date.weekday() >= 5)
    assert [f.dataType.simpleString() for f in year.schema][:3] == ["int", "date", "int"]


SALES = "invoice_id string, stock_code string, customer_id string, store_id string, sale_date date, quantity int, unit_price double"
VERSIONS = "effective_start_date date, effective_end_date date"


@pytest.fixture
def dims(frame):
    customer = frame(f"customer_id string, country string, customer_sk bigint, {VERSIONS}", ("C", "UK", 0, "2026-01-01", "2026-02-01"), ("C", "France", 1, "2026-02-01", None))
    product = frame(f"stock_code string, unit_price double, product_sk bigint, {VERSIONS}", ("A", 1.0, 0, "2026-01-01", None), ("B", 2.0, 1, "2026-01-01", None))
    store = frame("store_id string, region string", ("S2", "n"), ("S1", "s"))
    return customer, product, store


@pytest.fixture
def sold(frame, dims):
    sales = frame(
        SALES,
        ("I1", "A", "C", "S1", "2026-01-15", 3, 1.5),
        ("I1", "B", "C", "S1", "2026-01-15", 1, 2.0),
        ("I2", "A", "C", "S2", "2026-02-01", 2, 10.0),
        ("I3", "Z", None, "S9", "2026-03-01", None, 1.0),
    )
    return star.fact_sales(sales, dims[0], dims[1], star.dim_store(dims[2]))


def test_sales(sold, dims, frame):
    assert sold.columns == [
        "invoice_id", "stock_code", "customer_sk", "product_sk", "store_sk", "date_sk",
        "sale_date", "quantity", "unit_price", "line_total",
    ]
    assert as_rows(sold, "invoice_id", "stock_code", "customer_sk", "product_sk", "store_sk", "line_total") == [
        ("I1", "A", 0, 0, 0, 4.5), ("I1", "B", 0, 1, 0, 2.0), ("I2", "A", 1, 0, 1, 20.0),
        ("I3", "Z", None, None, None, None),
    ]


def test_sales_without_a_store_key(frame, dims):
    sales = frame(SALES, ("I1", "A", "C", "S1", "2026-01-15", 3, 1.5))
    fact = star.fact_sales(sales, *dims)
    assert fact.columns[4] == "store_id" and fact.first().store_id == "S1"


def test_returns_by_line_and_by_invoice(sold, frame):
    returns = frame(
        "return_invoice_id string, original_invoice_id string, stock_code string, quantity int",
        ("R1", "I1", "B", 1), ("R2", "I9", "A", 2),
    )
    assert as_rows(star.fact_returns(returns, sold)) == [
        ("R1", "I1", 0, 1, 1), ("R2", "I9", None, None, 2),
    ]
    assert as_rows(star.fact_returns(returns, sold, on_stock_code=False)) == [
        ("R1", "I1", 0, 0, 1), ("R2", "I9", None, None, 2),
    ]
    facts = star.fact_returns(returns, sold)
    resolved = [(0, 5, 0, 0.0), (1, 1, 1, 100.0)]
    assert as_rows(analytics.return_rate(sold, facts, resolved_only=True)) == resolved
    # Facts without a product are a group of their own.
    assert as_rows(analytics.return_rate(sold, facts)) == [*resolved, (None, None, 2, None)]


def test_totals_are_rounded_not_lines(spark):
    lines = spark.range(1000).selectExpr("CAST(1 AS BIGINT) AS customer_sk", "0.004D AS line_total")
    assert as_rows(analytics.top_customers(lines)) == [(1, 4.0)]


def test_orders_shipping_inventory_promotions(frame, dims):
    customer, product, store = dims
    orders = frame("order_id string, customer_id string, stock_code string, order_status string, order_date date", ("O1", "C", "A", "open", "2026-02-01"))
    fact = star.fact_online_orders(orders, customer, product)
    assert as_rows(fact) == [("O1", 1, 0, "open", dt.date(2026, 2, 1))]
    shipping = frame("shipment_id string, order_id string, carrier string, ship_date date", ("H1", "O1", "post", "2026-02-02"), ("H2", "O9", "post", "2026-02-02"))
    assert as_rows(star.fact_shipping(shipping, fact), "shipment_id", "customer_sk") == [("H1", 1), ("H2", None)]
    inventory = frame("store_id string, stock_code string, snapshot_date date, stock_on_hand int", ("S1", "A", "2026-01-05", 4), ("S1", "A", "2026-01-06", 3))
    levels = star.fact_inventory_snapshot(inventory, product, star.dim_store(store))
    assert levels.columns == ["store_sk", "product_sk", "snapshot_date", "stock_on_hand"]
    assert as_rows(analytics.latest_stock(levels, product)) == [(0, "A", dt.date(2026, 1, 6), 3)]
    promotions = frame("promo_id string, stock_code string, start_date date, end_date date, discount_pct double", ("X", "B", "2026-01-01", "2026-01-31", 0.2))
    assert as_rows(star.bridge_promotions(promotions, product)) == [
        ("X", 1, dt.date(2026, 1, 1), dt.date(2026, 1, 31), 0.2),
    ]


def test_reports(sold, dims):
    assert as_rows(analytics.top_customers(sold, resolved_only=True)) == [(0, 6.5), (1, 20.0)]
    assert as_rows(analytics.top_customers(sold)) == [(0, 6.5), (1, 20.0), (None, None)]
    assert [r.customer_sk for r in analytics.top_customers(sold, 1).collect()] == [1]
    by_country = analytics.revenue_by_country(sold, dims[0]).collect()
    assert [(r.country, r.revenue) for r in by_country] == [("France", 20.0), ("UK", 6.5)]
    assert as_rows(analytics.preview(sold, ["invoice_id", "stock_code"], 1), "invoice_id") == [("I1",)]


def test_interleaved_bits(spark):
    df = spark.range(64).selectExpr("id % 8 AS x", "id DIV 8 AS y")
    for row in df.select("x", "y", interleave_bits([df.x, df.y], 3).alias("z")).collect():
        expected = sum(((row.x >> i) & 1) << 2 * i | ((row.y >> i) & 1) << 2 * i + 1 for i in range(3))
        assert row.z == expected
    with pytest.raises(ValueError, match="62"):
        interleave_bits([df.x, df.y], 32)
