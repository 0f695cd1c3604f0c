"""Interval differences, late batches, numbers, and waves of gold tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from rows import as_rows

from strata.operators.joins import changed_intervals, pit_join, touched_days
from strata.operators.scd2 import CURRENT, END, HASH, START, scd2_merge, scd2_splice
from strata.plans import layers

VERSIONS = f"k string, sk bigint, {START} date, {END} date"
FIRST = dt.date(2026, 1, 1)


def day(number):
    return FIRST + dt.timedelta(days=number)


def test_an_earlier_end_changes_only_the_days_after_it(frame):
    before = frame(VERSIONS, ("a", 1, day(0), None), ("b", 2, day(0), day(9)), (None, 3, day(0), None))
    after = frame(VERSIONS, ("a", 1, day(0), day(5)), ("a", 4, day(5), None), ("b", 2, day(0), day(9)))
    assert as_rows(changed_intervals(before, after, ["k"], "sk")) == [
        ("a", day(5), dt.date(9999, 12, 31), True)
    ]
    gained = frame(VERSIONS, *[tuple(r) for r in after.collect()], ("c", 9, day(2), day(4)))
    assert as_rows(changed_intervals(after, gained, ["k"], "sk")) == [("c", day(2), day(4), False)]
    assert changed_intervals(after, after, ["k"], "sk").isEmpty()
    assert changed_intervals(after.limit(0), after.limit(0), ["k"], "sk").isEmpty()


def random_history(rng, keys, numbers):
    rows = []
    for k in keys:
        cuts = sorted(rng.sample(range(12), rng.randint(0, 4)))
        for start, end in zip(cuts, [*cuts[1:], None]):
            rows.append((k, next(numbers), day(start), None if end is None else day(end)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_facts_outside_of_the_intervals_keep_their_version(frame, seed):
    """Every fact that resolves otherwise lies in an interval of its key."""
    rng, keys = random.Random(seed), [f"k{i}" for i in range(12)]
    numbers = iter(range(1000))
    old = random_history(rng, keys, numbers)
    new = [v for v in old if rng.random() < 0.6] + [
        (k, n, s, e) for k, n, s, e in random_history(rng, keys[:5], numbers)
    ]
    before, after = frame(VERSIONS, *old), frame(VERSIONS, *new)
    facts = frame("k string, d date", *[(k, day(i)) for k in keys for i in range(14)], (None, day(1)), ("k1", None))
    sides = [pit_join(facts, dim, ["k"], "d", "sk").withColumnRenamed("sk", n) for dim, n in ((before, "b"), (after, "a"))]
    apart = sides[0].join(sides[1], ["k", "d"]).where(~F.col("a").eqNullSafe(F.col("b"))).select("k", "d")
    intervals = changed_intervals(before, after, ["k"], "sk")
    held = F.expr("d >= _from AND d < _until")
    assert set(as_rows(apart)) <= set(as_rows(facts.join(intervals, "k").where(held).select("k", "d").distinct()))
    days = {r[0] for r in touched_days(facts, intervals, ["k"], "d").collect()}
    assert {r[1] for r in as_rows(apart)} <= days


def fold(batches):
    """The versions that batches of {key: value} make, in the order of their days."""
    now, versions = {}, []
    for number in sorted(batches):
        for k, v in batches[number].items():
            if k in now and now[k][2] == v:
                continue
            if k in now:
                versions.append((*now[k], day(number)))
            now[k] = (k, day(number), v)
    return sorted(versions + [(*v, None) for v in now.values()], key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_batches_in_any_order_give_the_ordered_fold(spark, seed):
    rng = random.Random(seed)
    batches = {n: {f"k{i}": rng.choice("AB") for i in range(8) if rng.random() < 0.6} for n in range(5)}
    order = rng.sample(sorted(batches), len(batches))
    history, following, seen = None, 0, []
    for number in order:
        source = spark.createDataFrame(list(batches[number].items()) or [("none", "A")], "k string, v string")
        newest = max(seen, default=-1)
        if number > newest:
            history = scd2_merge(source, history, ["k"], ["v"], "sk", day(number))
        else:
            later = [(k, day(n)) for n in seen if n > number for k in batches[n]]
            own = history.join(source.select("k"), "k", "left_semi").select(*history.columns)
            others = history.join(source.select("k"), "k", "left_anti").select(*history.columns)
            spliced = scd2_splice(
                source, own, spark.createDataFrame(later, "k string, d date"), "d", ["k"], ["v"], "sk",
                day(number), following,
            )
            history = others.unionByName(spliced)
        history = spark.createDataFrame(history.collect(), history.schema)
        following = max(following, history.agg(F.max("sk")).first()[0] + 1)
        seen.append(number)
    assert as_rows(history, "k", START, "v", END) == fold({n: b or {"none": "A"} for n, b in batches.items()})
    assert history.groupBy("sk").count().where("count > 1").isEmpty()
    assert history.where(F.col(CURRENT) != F.col(END).isNull()).isEmpty() and HASH in history.columns


def test_a_number_is_not_given_twice(tables, frame):
    rows = frame("k string, n bigint", ("a", 0), ("b", 7))
    tables.write(rows, "silver", "t", numbered="n")
    assert tables.next_number("silver", "t", "n") == 8
    tables.write(rows.where("k = 'a'"), "silver", "t", numbered="n")
    tables.mark_consumed("silver", "t", ["x"])
    assert tables.next_number("silver", "t", "n") == 8
    tables.publish_as(("silver", "t"), "gold", "t")
    assert tables.next_number("gold", "t", "n") == 8 and tables.next_number("gold", "other", "n") == 0


def test_an_earlier_publication_can_be_read_until_it_is_pruned(tables, frame):
    for value in (1, 2):
        tables.write(frame("n bigint", (value,)), "silver", "t")
    assert as_rows(tables.read("silver", "t", version=1)) == [(1,)] and tables.readable("silver", "t", 1)
    tables.prune("silver", "t")
    assert not tables.readable("silver", "t", 1) and tables.readable("silver", "t", 2)


def test_waves():
    found = layers.waves(layers.GOLD_INPUTS)
    assert [set(w) for w in found] == [
        {"dim_customer", "dim_product", "dim_store", "dim_supplier", "dim_date"},
        {"fact_sales", "fact_online_orders", "fact_inventory_snapshot", "bridge_promotions"},
        {"fact_returns", "fact_shipping"},
    ]
    assert layers.waves(["fact_returns", "dim_date"]) == [["dim_date"], ["fact_returns"]]
