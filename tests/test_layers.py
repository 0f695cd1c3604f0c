import datetime as dt
from pathlib import Path

import pytest
from rows import as_rows
from pyspark.sql import functions as F

from strata.operators.quality import FAILED
from strata.plans import layers, star
from strata.operators.layout import _ranked, cluster
from strata.plans.retail import retail_specs
from strata.operators.scd2 import END, START
from strata.sources.landing import CORRUPT, read_landing, tag_metadata
from strata.spec import TableSpec, to_struct
from strata.streaming.ingest import stream_ingest

DAY1, DAY2, DAY3 = dt.date(2026, 7, 1), dt.date(2026, 7, 2), dt.date(2026, 7, 3)
CUSTOMER = retail_specs()["customer"]


def spec(name, types, key, **options):
    columns = [dict(zip(("name", "type"), c.split(":"))) for c in types.split()]
    return TableSpec(name, tuple(columns), tuple(key), **options)


INVOICE = spec(
    "invoice",
    "invoice_id:string stock_code:string quantity:integer",
    ["invoice_id", "stock_code"],
    dq_rules=({"type": "not_null", "column": "stock_code"},),
)


def land(folder: Path, name: str, *lines: str) -> str:
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")
    return str(folder)


@pytest.fixture
def landing(tmp_path):
    return tmp_path / "landing"


def test_malformed_cells_are_quarantined(tables, landing):
    path = land(landing, "a.csv", "invoice_id,stock_code,quantity", "INV1,A,5", "INV2,B,many", "INV3,C")
    result = layers.ingest_bronze(tables, INVOICE, path, DAY1)
    assert (result["valid_count"], result["invalid_count"]) == (1, 2)
    rejected = tables.read("quarantine", "invoice")
    assert {r[CORRUPT] for r in rejected.collect()} == {"INV2,B,many", "INV3,C"}
    assert all("well_formed(row)" in r[FAILED] for r in rejected.collect())
    assert CORRUPT not in tables.read("bronze", "invoice").columns


def test_failing_on_malformed_cells_looks_at_all_columns(spark, landing):
    path = land(landing, "a.csv", "invoice_id,stock_code,quantity", "INV1,A,many")
    strict = read_landing(spark, path, INVOICE.schema, on_bad="fail")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        strict.select("invoice_id").collect()
    with pytest.raises(ValueError, match="on_bad"):
        read_landing(spark, path, INVOICE.schema, on_bad="ignore")


def test_reordered_header_is_an_error(spark, landing):
    path = land(landing, "a.csv", "stock_code,invoice_id,quantity", "A,INV1,5")
    with pytest.raises(Exception, match="header"):
        read_landing(spark, path, INVOICE.schema).collect()


def test_audit_columns(frame, spark, landing):
    tagged = tag_metadata(frame("invoice_id string, quantity int", ("INV001", 5)), "b1", source="here")
    assert tagged.columns == [
        "invoice_id", "quantity", "_source_file", "_ingest_ts", "_batch_id", "_ingest_date",
    ]
    row = tagged.first()
    assert (row.invoice_id, row.quantity, row._source_file, row._batch_id) == ("INV001", 5, "here", "b1")
    assert dt.datetime.fromisoformat(row._ingest_ts).date() == row._ingest_date
    path = land(landing, "a.csv", "invoice_id,quantity", "INV001,5")
    schema = to_struct([{"name": "invoice_id", "type": "string"}, {"name": "quantity", "type": "integer"}])
    assert tag_metadata(read_landing(spark, path, schema)).first()._source_file.endswith("a.csv")


def test_bronze_to_silver(tables, landing):
    path = land(landing, "a.csv", "invoice_id,stock_code,quantity", "INV001,A100,5", "INV002,,3")
    bronze = layers.ingest_bronze(tables, INVOICE, path, DAY1)
    assert (bronze["valid_count"], bronze["invalid_count"]) == (1, 1)
    assert bronze["violations"] == {
        "not_null(stock_code)": 1, "business_key(invoice_id,stock_code)": 1,
    }
    silver = layers.refine_fact(tables, INVOICE, DAY1)
    assert (silver["incremental_count"], silver["valid_count"], silver["invalid_count"]) == (1, 1, 0)
    assert as_rows(tables.read("silver", "invoice"), "invoice_id") == [("INV001",)]


@pytest.mark.parametrize("mode", ["batch", "date"])
def test_two_days_of_customers(tables, landing, mode):
    header = "customer_id,country,segment"
    path = land(landing, "1.csv", header, "C001,United Kingdom,Retail", "C002,France,Retail", "C003,,Retail")
    bronze = layers.ingest_bronze(tables, CUSTOMER, path, DAY1)
    assert (bronze["valid_count"], bronze["invalid_count"]) == (2, 1)
    layers.refine_dimension(tables, CUSTOMER, DAY1, mode)
    land(landing, "2.csv", header, "C001,Germany,Retail", "C002,France,Retail")
    assert layers.ingest_bronze(tables, CUSTOMER, path, DAY2)["total_count"] == 2
    layers.refine_dimension(tables, CUSTOMER, DAY2, mode)
    columns = ["customer_id", "country", "customer_sk", "effective_start_date", "effective_end_date", "is_current"]
    expected = [
        ("C001", "Germany", 2, DAY2, None, True),
        ("C001", "United Kingdom", 0, DAY1, DAY2, False),
        ("C002", "France", 1, DAY1, None, True),
    ]
    assert as_rows(tables.read("silver", "customer"), *columns) == expected
    # Nothing new: a repeated run changes nothing.
    assert layers.ingest_bronze(tables, CUSTOMER, path, DAY3)["total_count"] == 0
    assert layers.refine_dimension(tables, CUSTOMER, DAY3, mode)["incremental_count"] == 0
    assert as_rows(tables.read("silver", "customer"), *columns) == expected


def test_closed_versions_are_not_rewritten(tables, landing):
    header = "customer_id,country,segment"
    for number, country in enumerate(["UK", "France", "Spain"]):
        path = land(landing, f"{number}.csv", header, f"C001,{country},Retail")
        layers.ingest_bronze(tables, CUSTOMER, path, DAY1 + dt.timedelta(days=number))
        layers.refine_dimension(tables, CUSTOMER, DAY1 + dt.timedelta(days=number))
    assert tables.published("silver", "customer").dirs == (
        "_gen=2/is_current=false", "_gen=3/is_current=false", "_gen=3/is_current=true",
    )
    assert as_rows(tables.read("silver", "customer"), "country", "customer_sk") == [
        ("France", 1), ("Spain", 2), ("UK", 0),
    ]


def test_second_batch_on_the_same_day(tables, landing):
    header = "invoice_id,stock_code,quantity"
    path = land(landing, "a.csv", header, "INV1,A,5")
    for mode, expected in (("date", 1), ("batch", 2)):
        layers.ingest_bronze(tables, INVOICE, path, DAY1)
        layers.refine_fact(tables, INVOICE, DAY1, mode)
        land(landing, "b.csv", header, "INV2,B,6")
        if mode == "date":
            layers.ingest_bronze(tables, INVOICE, path, DAY1)
            layers.refine_fact(tables, INVOICE, DAY1, mode)
        assert tables.read("silver", "invoice").count() == expected


def test_upsert_rewrites_only_touched_directories(tables, landing):
    lines = spec(
        "lines", "k:string v:integer day:date", ["k"], partition_by=("day",)
    )
    path = land(landing, "a.csv", "k,v,day", "a,1,2026-01-01", "b,2,2026-01-02")
    layers.ingest_bronze(tables, lines, path, DAY1)
    layers.refine_fact(tables, lines, DAY1)
    # b moves to another day, c is new.
    land(landing, "b.csv", "k,v,day", "b,20,2026-01-03", "c,3,2026-01-01")
    layers.ingest_bronze(tables, lines, path, DAY2)
    layers.refine_fact(tables, lines, DAY2)
    assert as_rows(tables.read("silver", "lines"), "k", "v", "day") == [
        ("a", 1, dt.date(2026, 1, 1)), ("b", 20, dt.date(2026, 1, 3)), ("c", 3, dt.date(2026, 1, 1)),
    ]
    assert tables.published("silver", "lines").dirs == (
        "_gen=1/day=2026-01-01", "_gen=2/day=2026-01-01", "_gen=2/day=2026-01-03",
    )


def test_duplicates_within_a_file(tables, landing):
    path = land(landing, "a.csv", "invoice_id,stock_code,quantity", "I,A,5", "I,A,7", "I,B,1")
    layers.ingest_bronze(tables, INVOICE, path, DAY1)
    result = layers.refine_fact(tables, INVOICE, DAY1)
    assert (result["incremental_count"], result["total_count"]) == (3, 2)
    assert as_rows(tables.read("silver", "invoice"), "stock_code", "quantity") == [("A", 7), ("B", 1)]


def test_silver_rejects_have_their_own_table(tables, landing):
    path = land(landing, "a.csv", "invoice_id,stock_code,quantity", "I,A,5", "I,B,-1")
    layers.ingest_bronze(tables, INVOICE, path, DAY1)
    stricter = spec(
        "invoice", "invoice_id:string stock_code:string quantity:integer",
        ["invoice_id", "stock_code"], dq_rules=({"type": "non_negative", "column": "quantity"},),
    )
    result = layers.refine_fact(tables, stricter, DAY1)
    assert (result["valid_count"], result["invalid_count"]) == (1, 1)
    assert as_rows(tables.read("quarantine", "invoice_silver"), "stock_code", FAILED) == [
        ("B", ["non_negative(quantity)"]),
    ]


def test_wrong_kind_is_refused(tables):
    with pytest.raises(ValueError, match="refine_dimension"):
        layers.refine_fact(tables, CUSTOMER, DAY1)
    with pytest.raises(ValueError, match="refine_fact"):
        layers.refine_dimension(tables, INVOICE, DAY1)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        layers.ingest_bronze(tables, INVOICE, "/nowhere/at/all", DAY1)


def test_reprocess_one_day(tables, tmp_path):
    root = tmp_path / "landing"
    land(root / "invoice", "a.csv", "invoice_id,stock_code,quantity", "I,A,5", "J,,1")
    layers.ingest_bronze(tables, INVOICE, str(root / "invoice"), DAY1)
    layers.refine_fact(tables, INVOICE, DAY1)
    land(root / "invoice", "a.csv", "invoice_id,stock_code,quantity", "I,A,6", "J,,1", "K,C,2")
    layers.reprocess(tables, [INVOICE], str(root), [DAY1])
    assert as_rows(tables.read("bronze", "invoice"), "invoice_id", "quantity") == [("I", 6), ("K", 2)]
    assert tables.read("quarantine", "invoice").count() == 1
    assert as_rows(tables.read("silver", "invoice"), "invoice_id", "quantity") == [("I", 6), ("K", 2)]


RETAIL_FILES = {
    "sales": ("I1,A,2,1.5,C1,S1,France,2026-07-02 10:00:00,2026-07-02", "I1,B,1,4.0,C1,S1,France,2026-07-02 10:00:00,2026-07-02"),
    "customer": ("C1,France,Retail", "C2,Germany,Retail"),
    "product": ("A,pen,1.5,P1", "B,cup,4.0,P1"),
    "store": ("S1,North,France,Main",),
    "supplier": ("P1,Maker",),
    "inventory": ("S1,A,2026-07-02,10", "S1,A,2026-07-03,8"),
    "promotions": ("X1,A,2026-07-02,2026-07-09,0.1",),
    "online_orders": ("O1,C2,B,open,2026-07-02",),
    "shipping": ("H1,O1,post,2026-07-01", "H2,O1,post,2999-01-01"),
    "returns": ("R1,I1,B,1",),
}


def test_all_retail_tables(tables, tmp_path):
    root, specs = tmp_path / "landing", retail_specs()
    for name, lines in RETAIL_FILES.items():
        header = ",".join(c["name"] for c in specs[name].columns)
        land(root / name, "1.csv", header, *lines)
    bronze = layers.run_bronze(tables, specs.values(), str(root), DAY1)
    assert bronze["shipping"]["violations"] == {"no_future_date(ship_date)": 1}
    silver = layers.run_silver(tables, specs.values(), DAY1, initial_start=dt.date(1900, 1, 1))
    early = layers.build_gold(tables, "fact_returns")
    assert early["row_count"] == 0 and "gold.fact_sales" in early["skipped"]
    gold = layers.run_gold(tables)
    assert {n: r["row_count"] for n, r in gold.items()} == {
        "dim_customer": 2, "dim_product": 2, "dim_store": 1, "dim_supplier": 1, "dim_date": 365,
        "fact_sales": 2, "fact_returns": 1, "fact_online_orders": 1, "fact_shipping": 1,
        "fact_inventory_snapshot": 2, "bridge_promotions": 1,
    }
    assert as_rows(
        tables.read("gold", "fact_sales"),
        "invoice_id", "customer_sk", "product_sk", "store_sk", "date_sk", "line_total",
    ) == [("I1", 0, 0, 0, 20260702, 3.0), ("I1", 0, 1, 0, 20260702, 4.0)]
    assert as_rows(tables.read("gold", "fact_returns")) == [("R1", "I1", 0, 1, 1)]
    assert as_rows(tables.read("gold", "fact_shipping"), "shipment_id", "customer_sk") == [("H1", 1)]
    steps = [*bronze.values(), *silver.values(), *gold.values()]
    metrics = layers.run_metrics(tables, steps)
    assert metrics.count() == 31
    assert metrics.where("level = 'WARNING'").select("table_name").collect()[0][0] == "shipping"


def test_incremental_gold_equals_a_full_build(tables, tmp_path):
    """New days, a moved sale, a late sale, new versions, then a new store; against full builds."""
    root, specs = tmp_path / "landing", retail_specs()
    names = ["sales", "customer", "product", "store"]
    gold = ["dim_customer", "dim_product", "dim_store", "fact_sales"]

    def run(day, **files):
        for name, lines in files.items():
            header = ",".join(c["name"] for c in specs[name].columns)
            land(root / name, f"{day}.csv", header, *lines)
        chosen = [specs[n] for n in names if n in files]
        layers.run_bronze(tables, chosen, str(root), day)
        layers.run_silver(tables, chosen, day, initial_start=dt.date(1900, 1, 1))

    def sale(invoice, code, day, store="S1", customer="C1"):
        return f"{invoice},{code},2,1.5,{customer},{store},France,{day} 10:00:00,{day}"

    def build_and_compare(full_build):
        before = tables.published("gold", "fact_sales")
        results = layers.run_gold(tables, gold, incremental=True)
        state = tables.published("gold", "fact_sales")
        kept = set(state.dirs) & set(before.dirs) if before else set()
        assert bool(kept) != full_build
        found = as_rows(tables.read("gold", "fact_sales"))
        dims = [tables.read("gold", n) for n in gold[:3]]
        assert found == as_rows(star.fact_sales(tables.read("silver", "sales"), *dims))
        return results["fact_sales"], {d.split("/")[1] for d in kept}

    run(
        DAY1,
        sales=[sale("I1", "A", "2026-06-01"), sale("I2", "A", "2026-06-30"), sale("I3", "B", DAY1)],
        customer=["C1,France,Retail"], product=["A,pen,1.5,P1"], store=["S1,North,France,Main"],
    )
    build_and_compare(full_build=True)
    assert layers.build_gold(tables, "fact_sales", incremental=True)["skipped"] == "unchanged"
    # A new day, and a product that did not exist before: earlier days stay.
    run(DAY2, sales=[sale("I4", "B", DAY2)], product=["B,cup,4.0,P1"])
    result, kept = build_and_compare(full_build=False)
    assert result["row_count"] == tables.read("gold", "fact_sales").count()
    assert kept == {"sale_date=2026-06-01", "sale_date=2026-06-30", "sale_date=2026-07-01"}
    # I2 moves to another day, I5 arrives late, C1 changes on day 3.
    run(
        DAY3,
        sales=[sale("I2", "A", "2026-06-15"), sale("I5", "B", DAY2), sale("I6", "A", DAY3)],
        customer=["C1,Germany,Retail"],
    )
    result, kept = build_and_compare(full_build=False)
    assert kept == {"sale_date=2026-06-01", "sale_date=2026-07-01"}
    # A new store that sorts first: known stores keep their keys, only the day of its sale is built.
    run(dt.date(2026, 7, 4), store=["S0,South,France,New"], sales=[sale("I7", "A", "2026-07-04", "S0")])
    result, kept = build_and_compare(full_build=False)
    assert kept == {f"sale_date={d}" for d in ("2026-06-01", "2026-06-15", DAY1, DAY2, DAY3)}
    assert as_rows(tables.read("gold", "dim_store"), "store_id", "store_sk") == [("S0", 1), ("S1", 0)]
    # Gold dimensions show the silver files; pruning silver keeps them.
    tables.prune("silver", "customer")
    assert tables.read("gold", "dim_customer").count() == 2
    assert set(tables.register("gold")) == set(gold)
    assert tables.spark.sql("SELECT count(*) FROM gold_fact_sales").first()[0] == 7


def test_clustered_files_cover_small_ranges(tables, spark):
    """Both columns prune: every file covers a part of each, not only of the first."""
    df = spark.range(20000).selectExpr("id * 7919 % 1000 AS a", "id * 104729 % 997 AS b")
    layers.write_clustered(tables, df, "gold", "t", ["a", "b"], partitions=16)
    spans = (
        tables.read("gold", "t")
        .groupBy(F.spark_partition_id().alias("p"), F.input_file_name().alias("file"))
        .agg(F.max("a") - F.min("a"), F.max("b") - F.min("b"))
        .collect()
    )
    assert len(spans) == 16
    assert sum(s[2] for s in spans) / 16 < 500 and sum(s[3] for s in spans) / 16 < 500
    assert as_rows(tables.read("gold", "t")) == as_rows(df)


def test_stream(tables, landing, tmp_path):
    path = land(landing, "a.csv", "invoice_id,stock_code,quantity", "I1,A,5", "I2,,3", "I3,B,x")
    checkpoint = str(tmp_path / "checkpoint")
    stream_ingest(tables, INVOICE, path, checkpoint, DAY1).awaitTermination()
    land(landing, "b.csv", "invoice_id,stock_code,quantity", "I1,A,6", "I4,D,1")
    stream_ingest(tables, INVOICE, path, checkpoint, DAY1).awaitTermination()
    assert as_rows(tables.read("silver", "invoice"), "invoice_id", "quantity") == [("I1", 6), ("I4", 1)]
    assert tables.read("quarantine", "invoice").count() == 2
    # Started again, the stream finds nothing; with a lost checkpoint it stores everything again.
    stream_ingest(tables, INVOICE, path, checkpoint, DAY1).awaitTermination()
    assert tables.read("bronze", "invoice").count() == 3
    stream_ingest(tables, INVOICE, path, str(tmp_path / "lost"), DAY1).awaitTermination()
    assert tables.read("bronze", "invoice").count() == 6
    other = land(tmp_path / "other", "a.csv", "invoice_id,stock_code,quantity", "I9,A,1")
    stream_ingest(tables, INVOICE, other, str(tmp_path / "second"), DAY1).awaitTermination()
    assert ("I9", 1) in as_rows(tables.read("silver", "invoice"), "invoice_id", "quantity")


def test_reprocessing_a_past_day_keeps_later_days(tables, tmp_path):
    root, header = tmp_path / "landing", "customer_id,country,segment"
    for day, country in ((DAY1, "UK"), (DAY2, "France"), (DAY3, "Germany")):
        land(root / "customer", f"{day}.csv", header, f"C1,{country},Retail", f"D{day.day},Spain,Retail")
        layers.ingest_bronze(tables, CUSTOMER, str(root / "customer"), day)
        layers.refine_dimension(tables, CUSTOMER, day)
    before = as_rows(tables.read("silver", "customer"), "customer_id", "country", START, "customer_sk")
    land(root / "customer", f"{DAY2}.csv", header, "C1,Italy,Retail", "E2,Spain,Retail")
    for _ in range(2):  # replaying changes nothing more
        layers.reprocess(tables, [CUSTOMER], str(root), [DAY2])
        found = as_rows(tables.read("silver", "customer"), "customer_id", "country", START, END)
        assert found == sorted(
            [
                ("C1", "UK", DAY1, DAY2), ("C1", "Italy", DAY2, DAY3), ("C1", "Germany", DAY3, None),
                ("D1", "Spain", DAY1, None), ("D3", "Spain", DAY3, None), ("E2", "Spain", DAY2, None),
            ],
            key=repr,
        )
    after = as_rows(tables.read("silver", "customer"), "customer_id", "country", START, "customer_sk")
    kept = {(r[0], r[2]): r[3] for r in before}
    assert all(kept.get((r[0], r[2]), r[3]) == r[3] for r in after)
    assert len({r[3] for r in after}) == len(after)


def test_catching_up_equals_daily_runs(tables, tmp_path):
    root, header = tmp_path / "landing", "customer_id,country,segment"
    for day, country in ((DAY1, "UK"), (DAY2, "France"), (DAY3, "Germany")):
        land(root, f"{day}.csv", header, f"C1,{country},Retail")
        layers.ingest_bronze(tables, CUSTOMER, str(root), day)
    counts = layers.refine_dimension(tables, CUSTOMER, DAY3)
    assert counts["incremental_count"] == 3
    assert as_rows(tables.read("silver", "customer"), "country", START, END) == [
        ("France", DAY2, DAY3), ("Germany", DAY3, None), ("UK", DAY1, DAY2)
    ]


def test_a_dropped_generation_is_not_numbered_again(tables, landing):
    header = "invoice_id,stock_code,quantity"
    for name, day in (("a", DAY1), ("b", DAY2)):
        path = land(landing, f"{name}.csv", header, f"I{name},A,1")
        layers.ingest_bronze(tables, INVOICE, path, day)
        layers.refine_fact(tables, INVOICE, day)
    tables.replace_partition(None, "bronze", "invoice", "_ingest_date", DAY2)
    tables.prune("bronze", "invoice")
    layers.ingest_bronze(tables, INVOICE, land(landing, "c.csv", header, "Ic,A,1"), DAY3)
    assert layers.refine_fact(tables, INVOICE, DAY3)["incremental_count"] == 1


def test_the_later_run_of_a_day_is_newer(tables, landing):
    header = "invoice_id,stock_code,quantity"
    for name, quantity in (("a", 5), ("b", 4)):
        path = land(landing, f"{name}.csv", header, f"I,A,{quantity}")
        layers.ingest_bronze(tables, INVOICE, path, DAY1)
    layers.refine_fact(tables, INVOICE, DAY1)
    assert as_rows(tables.read("silver", "invoice"), "quantity") == [(4,)]


def test_tables_at_once(tables, tmp_path):
    """Several tables at the same time give what one after the other gives; failures come through."""
    root, specs = tmp_path / "landing", retail_specs()
    for name, lines in RETAIL_FILES.items():
        land(root / name, "1.csv", ",".join(c["name"] for c in specs[name].columns), *lines)
    bronze = layers.run_bronze(tables, specs.values(), str(root), DAY1, at_once=4)
    silver = layers.run_silver(tables, specs.values(), DAY1, at_once=4)
    assert list(bronze) == list(silver) == list(specs)
    assert {n: r["valid_count"] for n, r in silver.items()} == {
        n: len(lines) - (n == "shipping") for n, lines in RETAIL_FILES.items()
    }
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        layers.run_bronze(tables, specs.values(), "/nowhere/at/all", DAY1, at_once=4)


@pytest.mark.parametrize("one", [INVOICE, CUSTOMER])
def test_files_without_rows(tables, landing, one):
    header = ",".join(c["name"] for c in one.columns)
    path = land(landing, "empty.csv", header)
    assert layers.ingest_bronze(tables, one, path, DAY1)["total_count"] == 0
    refine = layers.refine_dimension if one.keeps_history else layers.refine_fact
    assert refine(tables, one, DAY1)["incremental_count"] == 0
    land(landing, "rows.csv", header, "a,b,1")
    assert layers.ingest_bronze(tables, one, path, DAY2)["valid_count"] == 1
    assert refine(tables, one, DAY2)["valid_count"] == 1
    assert tables.read("silver", one.name).count() == 1


def test_everything_rejected(tables, landing):
    path = land(landing, "bad.csv", "invoice_id,stock_code,quantity", "I,,1")
    assert layers.ingest_bronze(tables, INVOICE, path, DAY1)["invalid_count"] == 1
    assert layers.refine_fact(tables, INVOICE, DAY1)["incremental_count"] == 0
    assert not tables.exists("silver", "invoice") or tables.read("silver", "invoice").isEmpty()


def test_ranks_spread_a_skewed_column(spark):
    rows = spark.range(4000).selectExpr("IF(id % 2 = 0, 0, pow(id, 5)) AS a", "id AS b", "CAST(NULL AS INT) AS c")
    for scale, columns in (("rank", ["a", "b"]), ("linear", ["a", "b"]), ("rank", ["c"])):
        assert cluster(rows, columns, scale=scale).exceptAll(rows).isEmpty()
    cell = _ranked(rows, ["a"], 3)[0]
    counts = {r[0]: r[1] for r in rows.groupBy(cell).count().collect()}
    assert counts[0] == 2000 and len(counts) == 5 and max(n for k, n in counts.items() if k) < 600
    assert cluster(rows.limit(0), ["a"], scale="rank").isEmpty()
    with pytest.raises(ValueError, match="scale"):
        cluster(rows, ["a"], scale="other")
