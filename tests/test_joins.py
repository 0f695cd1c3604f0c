import datetime as dt
import random

import pytest
from rows import as_rows
from pyspark.sql import functions as F

from strata.operators.joins import (
    fk_audit,
    inherit_keys,
    live_interval,
    lookup,
    pit_join,
)

DIM = (
    "customer_sk string, customer_id string, country string, effective_start_date date, "
    "effective_end_date date"
)
FACT = "invoice_id string, customer_id string, sale_date date"
BOTH = pytest.mark.parametrize("strategy", ["range", "asof", "auto"])


def resolve(fact, dim, closed="left", strategy="auto"):
    return pit_join(fact, dim, ["customer_id"], "sale_date", "customer_sk", closed, strategy)


@BOTH
def test_old_and_new_version(frame, strategy):
    dim = frame(
        DIM,
        ("1", "C001", "United Kingdom", "2025-01-01", "2026-07-01"),
        ("2", "C001", "Germany", "2026-07-02", None),
    )
    fact = frame(FACT, ("INV001", "C001", "2026-01-15"), ("INV002", "C001", "2026-08-01"))
    for closed in ("left", "both"):
        found = resolve(fact, dim, closed, strategy)
        assert as_rows(found, "invoice_id", "customer_sk") == [("INV001", "1"), ("INV002", "2")]
        assert found.columns == ["invoice_id", "customer_id", "sale_date", "customer_sk"]


@BOTH
def test_open_version(frame, strategy):
    dim = frame(DIM, ("3", "C002", "France", "2026-01-01", None))
    fact = frame(FACT, ("INV003", "C002", "2026-12-01"))
    assert as_rows(resolve(fact, dim, strategy=strategy), "customer_sk") == [("3",)]


@BOTH
def test_the_day_of_a_change(frame, strategy):
    dim = frame(
        DIM,
        ("1", "C001", "UK", "2026-01-01", "2026-03-01"),
        ("2", "C001", "Germany", "2026-03-01", None),
    )
    fact = frame(
        FACT, ("before", "C001", "2026-02-28"), ("on", "C001", "2026-03-01"), ("early", "C001", "2025-12-31")
    )
    for closed in ("left", "both"):
        assert as_rows(resolve(fact, dim, closed, strategy), "invoice_id", "customer_sk") == [
            ("before", "1"), ("early", None), ("on", "2"),
        ]


@BOTH
def test_last_valid_day_counts_only_when_closed_on_both_sides(frame, strategy):
    dim = frame(DIM, ("1", "C001", "UK", "2026-01-01", "2026-01-31"))
    fact = frame(FACT, ("INV", "C001", "2026-01-31"))
    assert as_rows(resolve(fact, dim, "left", strategy), "customer_sk") == [(None,)]
    assert as_rows(resolve(fact, dim, "both", strategy), "customer_sk") == [("1",)]


@BOTH
def test_two_changes_on_one_day(frame, strategy):
    dim = frame(
        DIM,
        ("1", "C", "a", "2026-01-01", "2026-02-01"),
        ("2", "C", "b", "2026-02-01", "2026-02-01"),
        ("3", "C", "c", "2026-02-01", None),
    )
    fact = frame(FACT, ("INV", "C", "2026-02-01"))
    assert as_rows(resolve(fact, dim, strategy=strategy), "customer_sk") == [("3",)]


@BOTH
def test_nulls_stay_unmatched(frame, strategy):
    dim = frame(DIM, ("1", "C001", "UK", "2026-01-01", None), ("2", None, "UK", "2026-01-01", None))
    fact = frame(FACT, ("a", None, "2026-02-01"), ("b", "C001", None), ("c", "C999", "2026-02-01"))
    assert as_rows(resolve(fact, dim, strategy=strategy), "invoice_id", "customer_sk") == [
        ("a", None), ("b", None), ("c", None),
    ]


@pytest.mark.parametrize("partitions", ["1", "32"])
def test_strategies_agree_with_brute_force(spark, frame, partitions):
    """A key with a third of all facts and a hundred versions, at two partition counts."""
    pick, start = random.Random(7), dt.date(2026, 1, 1)
    versions = []
    for key, count in [("hot", 100), ("a", 3), ("b", 1), ("gap", 2)]:
        days = sorted(pick.sample(range(365), count))
        ends = [*days[1:], None]
        if key == "gap":
            ends[0] = days[0] + 1
        versions += [
            (f"{key}{i}", key, "x", str(start + dt.timedelta(days=d)),
             None if e is None else str(start + dt.timedelta(days=e)))
            for i, (d, e) in enumerate(zip(days, ends))
        ]
    facts = [
        (f"i{i}", "hot" if i % 3 == 0 else pick.choice(["a", "b", "gap", "none"]),
         str(start + dt.timedelta(days=pick.randrange(-10, 380))))
        for i in range(600)
    ]
    expected = []
    for invoice, key, day in facts:
        hits = [v[0] for v in versions if v[1] == key and v[3] <= day and (v[4] is None or day < v[4])]
        assert len(hits) <= 1
        expected.append((invoice, hits[0] if hits else None))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for strategy in ("range", "asof", "auto"):
            found = resolve(frame(FACT, *facts), frame(DIM, *versions), strategy=strategy)
            assert as_rows(found, "invoice_id", "customer_sk") == sorted(expected, key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_arguments_are_checked(frame):
    dim, fact = frame(DIM), frame(FACT)
    with pytest.raises(ValueError, match="closed"):
        resolve(fact, dim, closed="right")
    with pytest.raises(ValueError, match="strategy"):
        resolve(fact, dim, strategy="hash")



def test_lookup(frame):
    fact = frame("id int, store_id string", (1, "S1"), (2, "S9"), (3, None))
    dim = frame("store_id string, region string", ("S1", "North"))
    assert as_rows(lookup(fact, dim, ["store_id"], ["region"]), "id", "region") == [
        (1, "North"), (2, None), (3, None),
    ]


def test_inherited_keys_keep_the_grain(frame):
    sold = frame(
        "invoice_id string, stock_code string, customer_sk int, product_sk int",
        ("I1", "A", 1, 10), ("I1", "B", 1, 11), ("I2", "A", 2, 10),
    )
    back = frame("ret string, invoice_id string, stock_code string", ("R1", "I1", "B"), ("R2", "I3", "A"))
    keys = ["customer_sk", "product_sk"]
    exact = inherit_keys(back, sold.union(sold), ["invoice_id", "stock_code"], keys)
    assert as_rows(exact, "ret", *keys) == [("R1", 1, 11), ("R2", None, None)]
    by_invoice = inherit_keys(back, sold, ["invoice_id"], keys)
    assert as_rows(by_invoice, "ret", *keys) == [("R1", 1, 10), ("R2", None, None)]


def test_fk_audit(frame):
    fact = frame("customer_sk int", (1,), (1,), (7,), (None,))
    dim = frame("customer_sk int", (1,), (2,))
    assert as_rows(fk_audit(fact, "f", {"customer_sk": dim})) == [("f", "customer_sk", 4, 1, 1)]
    two = fact.withColumn("store_id", F.lit("S1"))
    stores = frame("store_id string", ("S2",))
    assert as_rows(fk_audit(two, "f", {"customer_sk": dim, "store_id": stores})) == [
        ("f", "customer_sk", 4, 1, 1), ("f", "store_id", 4, 0, 4),
    ]
    empty = fk_audit(fact.limit(0), "f", {"customer_sk": dim})
    assert as_rows(empty) == [("f", "customer_sk", 0, 0, 0)]


def test_many_versions_choose_the_asof_plan(spark):
    dim = spark.range(100).select(
        F.lit("k").alias("customer_id"),
        F.col("id").alias("customer_sk"),
        F.date_add(F.lit(dt.date(2026, 1, 1)), F.col("id").cast("int")).alias("effective_start_date"),
        F.date_add(F.lit(dt.date(2026, 1, 2)), F.col("id").cast("int")).alias("effective_end_date"),
    )
    fact = spark.range(10).select(
        F.lit("k").alias("customer_id"),
        F.date_add(F.lit(dt.date(2026, 1, 1)), F.col("id").cast("int")).alias("sale_date"),
    )
    plan = resolve(fact, dim)._jdf.queryExecution().toString()
    assert "last(_version" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_best_live_interval_against_brute_force(frame):
    """Overlapping, open, empty and unrelated intervals; one key holds most of both sides."""
    pick, start = random.Random(11), dt.date(2026, 1, 1)
    day = lambda n: str(start + dt.timedelta(days=n))
    promos = []
    for i in range(120):
        begin, length = pick.randrange(-60, 150), pick.randrange(-2, 70)
        end = None if i % 17 == 0 else day(begin + length)
        promos.append((f"p{i:03}", "hot" if i % 3 else "b", day(begin), end, pick.choice([0.1, 0.2])))
    facts = [
        (f"i{i}", None if i % 29 == 0 else pick.choice(["hot", "hot", "b", "c"]),
         None if i % 31 == 0 else day(pick.randrange(0, 100)))
        for i in range(300)
    ]
    expected = []
    for invoice, code, when in facts:
        live = [
            (-p[4], p[0]) for p in promos
            if code and when and p[1] == code and p[2] <= when and (p[3] is None or when <= p[3])
        ]
        expected.append((invoice, min(live)[1] if live else None))
    fact = frame("invoice_id string, stock_code string, sale_date date", *facts)
    promo = frame("promo_id string, stock_code string, start_date date, end_date date, pct double", *promos)

    def run(some_facts):
        return live_interval(
            some_facts, promo, ["stock_code"], "sale_date", "start_date", "end_date",
            [F.desc("pct"), F.asc("promo_id")], ["promo_id", "pct"],
        )

    assert as_rows(run(fact), "invoice_id", "promo_id") == sorted(expected, key=repr)
    assert run(fact.limit(0)).isEmpty()


def test_some_fifty_versions_a_key_need_no_timeline(spark):
    """Each fact is compared with its key's versions; three shuffles of the timeline are saved."""
    start = F.expr("date_add(DATE'2020-01-01', cast(id AS int))")
    dim = spark.range(50).select(
        F.lit("C").alias("customer_id"), F.col("id").alias("customer_sk"),
        start.alias("effective_start_date"), F.date_add(start, 1).alias("effective_end_date"),
    )
    fact = spark.range(100).select(
        F.col("id").alias("invoice_id"), F.lit("C").alias("customer_id"), start.alias("sale_date")
    )
    found = resolve(fact, dim)
    assert "Union" not in found._jdf.queryExecution().executedPlan().toString()
    assert as_rows(found, "invoice_id", "customer_sk") == sorted(
        ((i, i if i < 50 else None) for i in range(100)), key=repr
    )
