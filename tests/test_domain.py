"""The retail tables over rows of their own."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from rows import as_rows

from strata.plans import domain, registered, star


@pytest.fixture
def given(frame, tmp_path):
    lines = [
        (1, 10, 100, 1, 2.0, 8.0, "R", "2026-01-01"), (1, 10, 100, 2, 2.0, 6.0, "N", "2026-01-02"),
        (1, 9, 101, 3, 1.0, 5.0, "N", "2026-01-02"), (None, 9, 101, 1, 1.0, 5.0, "N", "2026-01-03"),
        (7, 9, 101, 1, 1.0, 4.0, "N", "2026-01-03"),
    ]
    schema = (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_returnflag string, l_shipdate date"
    )
    frame(schema, *lines).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(1, 5, "2026-01-01"), (2, 5, "2026-01-02")]
    frame("o_orderkey bigint, o_custkey bigint, o_orderdate date", *orders).write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_sales_are_dealt_out_by_order_once(spark, given):
    """One shuffle of the lines serves the deduplication and the join; lines without an order go first."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sold = domain.sales(spark, given)
        assert sold._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        day = dt.date(2026, 1, 1)
        columns = ["invoice_id", "stock_code", "quantity", "unit_price", "customer_id", "store_id", "sale_date"]
        assert as_rows(sold, *columns) == [
            ("1", "10", 2, 3.0, "5", "100", day), ("1", "9", 1, 5.0, "5", "101", day),
        ]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_keys_as_numbers_give_the_same_history(spark, given):
    text = domain.product_history(spark, given)
    number = domain.product_history(spark, given, F.col, keep=())
    shown = ["stock_code", "effective_start_date", "effective_end_date", "product_sk"]
    as_text = number.withColumn("stock_code", F.col("stock_code").cast("string"))
    assert as_rows(as_text, *shown) == as_rows(text, *shown)
    assert "unit_price" not in number.columns and number.schema["stock_code"].dataType.simpleString() == "bigint"


def test_landing_files_grow_with_the_sales():
    """Two micro-batches have half of the files each, and no file has more than its share of lines."""
    assert [registered._sales_files(n) for n in (0, 1, 4_000_000, 4_000_001, 216_000_000)] == [2, 2, 2, 4, 108]


def test_an_order_finds_its_customer_before_its_lines(spark, given, frame):
    """The fact is the same as over sales alone, and its lines are dealt out by no customer."""
    sold = "customer_id bigint, customer_sk bigint, effective_start_date date, effective_end_date date"
    customer = frame(sold, (5, 1, "2025-01-01", "2026-01-01"), (5, 2, "2026-01-01", None))
    made = "stock_code bigint, product_sk bigint, effective_start_date date, effective_end_date date"
    product = frame(made, (10, 7, "2025-01-01", None))
    stores = frame("store_id bigint, store_sk bigint", (100, 3), (101, 4))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        early = star.fact_sales(registered._sold(spark, given, customer), customer, product, stores)
        late = star.fact_sales(domain.sales(spark, given, F.col), customer, product, stores)
        assert as_rows(early) == as_rows(late)
        assert as_rows(early, "invoice_id", "stock_code", "customer_sk") == [(1, 10, 2), (1, 9, 2)]
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (early, late)]
        by_order, by_customer = "Exchange hashpartitioning(l_orderkey", "Exchange hashpartitioning(customer_id"
        assert [p.index(by_customer) > p.index(by_order) for p in plans] == [True, False]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("on_stock_code", [True, False])
def test_sales_and_returns_share_one_shuffle_of_the_lines(spark, frame, tmp_path, on_stock_code):
    """Lines without an order or a part and lines that come twice are returned as from lines of their own."""
    schema = (
        "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, "
        "l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate date"
    )
    lines = [
        (1, 1, 10, 100, 2.0, 8.0, "R", "F", "2026-01-01"), (1, 1, 10, 100, 2.0, 8.0, "R", "F", "2026-01-01"),
        (1, 2, 9, 101, 1.0, 5.0, "R", "F", "2026-01-02"), (1, 2, 9, 101, 1.0, 5.0, "N", "F", "2026-01-03"),
        (2, 1, None, 101, 3.0, 5.0, "R", "F", "2026-01-03"), (7, 1, 9, 101, 4.0, 4.0, "R", "F", "2026-01-03"),
        (None, 1, 9, 101, 5.0, 4.0, "R", "F", "2026-01-03"), (None, 1, 9, 101, 6.0, 4.0, "R", "F", "2026-01-02"),
    ]
    frame(schema, *lines).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(1, 5, "2026-01-01"), (2, 6, "2026-01-02")]
    frame("o_orderkey bigint, o_custkey bigint, o_orderdate date", *orders).write.parquet(f"{tmp_path}/orders.parquet")
    folder, before = str(tmp_path), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found, plans = [], []
        for shared in (None, domain.lines_by_order(spark, folder)):
            sold = domain.sales(spark, folder, F.col, None, shared).withColumnsRenamed(
                {"customer_id": "customer_sk", "store_id": "product_sk"}
            )
            back = star.fact_returns(domain.returns(spark, folder, F.col, shared), sold, on_stock_code)
            found.append(as_rows(back))
            back.collect()
            plans.append(back._jdf.queryExecution().executedPlan().toString())
        assert found[1] == found[0]
        assert sorted((r[1:] for r in found[1]), key=str) == sorted(
            [(1, 5, 100, 2), (2, *((None, None) if on_stock_code else (6, 101)), 3), (7, None, None, 4),
             (None, None, None, 5)], key=str,
        )
        assert ["ReusedExchange" in p for p in plans] == [False, True]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sales_leave_behind_what_nobody_reads(spark, frame, tmp_path):
    """What is kept is that of the whole rows, whichever column breaks a tie; the rest is not shuffled."""
    lines = [
        (1, 10, 100, 1, 2.0, 8.0, "2026-01-02"), (1, 10, 101, 2, 3.0, 6.0, "2026-01-02"),
        (1, 10, 101, 3, 1.0, 5.0, "2026-01-02"), (1, 10, 102, 9, 9.0, 9.0, "2026-01-01"),
        (1, 9, None, 1, 1.0, 4.0, "2026-01-02"), (1, 9, None, 1, None, 5.0, "2026-01-02"),
        (2, 9, 7, 1, 2.0, 4.0, None), (2, 9, 7, 1, 2.0, 3.0, None), (2, None, 8, 1, 2.0, 3.0, "2026-01-02"),
        (2, None, 8, 2, 4.0, 3.0, "2026-01-02"), (None, 9, 7, 1, 2.0, 4.0, "2026-01-02"), (3, 9, 7, 1, 2.0, 4.0, None),
    ]
    schema = (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_shipdate date"
    )
    frame(schema, *lines).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(1, 5, "2026-01-01"), (2, None, "2026-01-02"), (2, 6, None)]
    frame("o_orderkey bigint, o_custkey bigint, o_orderdate date", *orders).write.parquet(f"{tmp_path}/orders.parquet")
    whole = domain.sales(spark, str(tmp_path), F.col)
    for last in ("invoice_id", "store_id", "quantity", "unit_price"):
        kept = ["sale_date", "stock_code", "invoice_id", *([] if last == "invoice_id" else [last])]
        narrow = domain.sales(spark, str(tmp_path), F.col, keep=kept)
        assert narrow.columns == kept and narrow.count() == 6
        assert as_rows(narrow, *kept) == as_rows(whole, *kept)
    bare = domain.sales(spark, str(tmp_path), F.col, keep=("invoice_id", "stock_code", "sale_date"))
    plan = bare._jdf.queryExecution().optimizedPlan().toString()
    assert not any(c in plan.split("Repartition")[0] for c in ("l_suppkey", "l_linenumber", "l_extendedprice"))


def test_promotions_shuffle_only_what_they_read(monkeypatch, spark):
    asked = []

    def noted(spark, folder, *more, **options):
        asked.append(options.get("keep"))
        raise InterruptedError

    monkeypatch.setattr(domain, "sales", noted)
    with pytest.raises(InterruptedError):
        registered.promotions_at_sale(spark, "nowhere")
    assert asked == [("invoice_id", "stock_code", "sale_date")]


def test_sales_find_their_region_before_their_lines(spark, frame, tmp_path):
    """Lines are dealt out by no customer; rows are those of a join with the sales, repeated and NULL keys too."""
    lines = [(o, p, 100 + p, p, 2.0, 8.0, "R", "F", f"2026-01-0{p}") for o in (1, 2, 3, 4) for p in (1, 2)]
    lines += [(1, 1, 101, 1, 2.0, 8.0, "N", "O", "2026-01-05"), (None, 1, 101, 1, 2.0, 8.0, "R", "O", "2026-01-05")]
    tables = {
        "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                     "l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate date", lines),
        "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string, o_orderdate date",
                   [(1, 5, "F", "1", "2026-01-01"), (2, 6, "O", "1", "2026-01-02"), (3, None, "O", "2", "2026-01-02"),
                    (4, 7, "F", "1", "2026-01-03")]),
        "customer": ("c_custkey bigint, c_nationkey int", [(5, 1), (5, 2), (6, None), (7, 3), (None, 1)]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(1, "A", 1), (2, "B", 2), (3, "C", 9)]),
        "region": ("r_regionkey int, r_name string", [(1, "EUROPE"), (2, "MIDDLE EAST")]),
        "supplier": ("s_suppkey bigint, s_name string, s_nationkey int", [(101, "S", 1)]),
        "part": ("p_partkey bigint, p_name string, p_brand string, p_size int, p_retailprice double", [(1, "P", "B", 1, 2.0)]),
    }
    for name, (schema, rows) in tables.items():
        frame(schema, *rows).write.parquet(f"{tmp_path}/{name}.parquet")
    folder = str(tmp_path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        landed = registered._retail_landing(spark, folder)["sales"]
        countries = {"5": ("MIDDLE EAST", "United Kingdom")}
        expected = [
            (r.invoice_id, r.stock_code, r.customer_id, c)
            for r in domain.sales(spark, folder).collect() for c in countries.get(r.customer_id, (None,))
        ]
        assert as_rows(landed, "invoice_id", "stock_code", "customer_id", "country") == sorted(expected, key=repr)
        joins = landed._jdf.queryExecution().optimizedPlan().toString().split("Join ")[1:]
        assert joins[0].startswith("Inner, (l_orderkey") and joins[1].startswith("LeftOuter, (customer_id")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_shipments_and_returns_share_their_latest_lines(monkeypatch, spark, frame, tmp_path):
    """All landing files are those of the frames one by one, and the latest lines are looked for once."""
    asked, found = [], domain.latest_lines
    rows = [(1, 1, 101, 1, 2.0, 8.0, "R", "F", "2026-01-01"), (1, 1, 101, 1, 3.0, 8.0, "N", "O", "2026-01-05"),
            (None, 1, 101, 1, 2.0, 8.0, "R", "O", "2026-01-05"), (2, 2, 101, 1, 1.0, 8.0, "R", "O", None)]
    frame("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
          "l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate date", *rows
          ).write.parquet(f"{tmp_path}/lineitem.parquet")
    folder = str(tmp_path)
    alone = [as_rows(f(spark, folder)) for f in (domain.shipping, domain.returns)]
    monkeypatch.setattr(domain, "latest_lines", lambda *a: asked.append(a) or found(*a))
    landed = {}
    monkeypatch.setattr(registered, "_retail_landing", lambda s, f, latest: {
        "shipping": domain.shipping(s, f, latest), "returns": domain.returns(s, f, latest=latest)})
    monkeypatch.setattr(registered, "export_landing", lambda df, path: landed.update({path: as_rows(df)}))
    registered._land_retail(spark, folder, "landing")
    assert [landed["landing/shipping"], landed["landing/returns"]] == alone and len(alone[1]) == 2
    assert len(asked) == 1
