import datetime as dt
import random

import pytest
from rows import as_rows
from pyspark.sql import functions as F

from strata.functions.columns import row_hash
from strata.operators.scd2 import (
    START,
    current_versions,
    scd2_diff,
    scd2_initial,
    scd2_merge,
    scd2_rebuild,
    version_history,
)
from strata.operators.surrogate import dense_sk
from strata.session import materialize

DAY1, DAY2 = dt.date(2026, 1, 1), dt.date(2026, 1, 2)
SCHEMA = "customer_id string, country string"


def load(source, target, as_of, initial_start=None):
    return scd2_merge(source, target, ["customer_id"], ["country"], "sk", as_of, initial_start)


VERSION = ["customer_id", "country", "sk", "effective_start_date", "effective_end_date", "is_current"]


def test_first_load(frame):
    loaded = load(frame(SCHEMA, ("C002", "France"), ("C001", "UK")), None, DAY1)
    assert as_rows(loaded, *VERSION) == [
        ("C001", "UK", 0, DAY1, None, True), ("C002", "France", 1, DAY1, None, True),
    ]
    dated_back = load(frame(SCHEMA, ("C001", "UK")), None, DAY1, dt.date(1900, 1, 1))
    assert dated_back.first().effective_start_date == dt.date(1900, 1, 1)


def test_change_closes_and_opens(frame):
    first = load(frame(SCHEMA, ("C001", "UK")), None, DAY1)
    second = load(frame(SCHEMA, ("C001", "France")), first, DAY2)
    assert as_rows(second, *VERSION) == [
        ("C001", "France", 1, DAY2, None, True), ("C001", "UK", 0, DAY1, DAY2, False),
    ]


@pytest.mark.parametrize("rows", [[("C001", "UK")], []])
def test_no_change_and_empty_batch_do_nothing(frame, rows):
    first = load(frame(SCHEMA, ("C001", "UK")), None, DAY1)
    assert load(frame(SCHEMA, *rows), first, DAY2) is first


def test_mixed_batch(frame):
    first = load(frame(SCHEMA, ("C001", "UK"), ("C002", "France")), None, DAY1)
    batch = frame(SCHEMA, ("C001", "Germany"), ("C002", "France"), ("C003", "Spain"))
    second = load(batch, first, DAY2)
    assert as_rows(second, *VERSION) == [
        ("C001", "Germany", 2, DAY2, None, True),
        ("C001", "UK", 0, DAY1, DAY2, False),
        ("C002", "France", 1, DAY1, None, True),
        ("C003", "Spain", 3, DAY2, None, True),
    ]
    assert as_rows(load(batch, second, DAY2), *VERSION) == as_rows(second, *VERSION)
    assert as_rows(current_versions(second), "customer_id") == [("C001",), ("C002",), ("C003",)]
    assert as_rows(version_history(second, ["customer_id"]), "customer_id", "version")[:2] == [
        ("C001", 1), ("C001", 2),
    ]


def test_nulls_and_separators_do_not_hide_changes(frame):
    schema = "k string, a string, b string"
    old = frame(schema, ("1", None, "x"), ("2", "a||b", "c"), ("3", None, None), ("4", "u", "v"))
    new = frame(schema, ("1", "x", None), ("2", "a", "b||c"), ("3", None, None), ("4", "u", "v"))
    assert as_rows(scd2_diff(new, old, ["k"], ["a", "b"]), "k") == [("1",), ("2",)]
    hashed = old.unionByName(new).withColumn("h", row_hash(["a", "b"]))
    assert hashed.select("h").distinct().count() == 6


def test_untracked_columns_change_nothing(frame):
    schema = "customer_id string, country string, phone string"
    first = load(frame(schema, ("C001", "UK", "1")), None, DAY1)
    assert load(frame(schema, ("C001", "UK", "2")), first, DAY2) is first


def random_feed(seed, keys=8, days=6, rows=90):
    pick = random.Random(seed)
    start = dt.date(2026, 1, 1)
    return [
        (
            # One key holds about a third of all rows.
            "k0" if pick.random() < 0.33 else f"k{pick.randrange(keys)}",
            pick.choice(["a", "b", None]),
            pick.choice(["x", "y"]),
            str(start + dt.timedelta(days=pick.randrange(days))),
            i,
        )
        for i in range(rows)
    ]


@pytest.mark.parametrize("seed,initial", [(1, None), (2, None), (3, dt.date(1900, 1, 1))])
def test_rebuild_equals_the_fold_of_daily_merges(frame, seed, initial):
    feed = frame("k string, a string, b string, day date, seq int", *random_feed(seed)).cache()
    rebuilt = scd2_rebuild(
        feed, ["k"], ["a", "b"], "sk", "day", ["seq"], initial_start=initial
    )
    state, days = None, sorted(r[0] for r in feed.select("day").distinct().collect())
    for day in days:
        newest = {}
        for row in feed.where(F.col("day") == F.lit(day)).orderBy("seq").collect():
            newest[row.k] = (row.k, row.a, row.b)
        batch = frame("k string, a string, b string", *newest.values())
        state = materialize(scd2_merge(batch, state, ["k"], ["a", "b"], "sk", day, initial))
    columns = ["k", "a", "b", "sk", "effective_start_date", "effective_end_date", "is_current"]
    assert as_rows(rebuilt, *columns) == as_rows(state, *columns)
    # One current version per key, and versions of a key do not overlap.
    assert rebuilt.where("is_current").groupBy("k").count().where("count <> 1").isEmpty()
    pairs = rebuilt.alias("x").join(
        rebuilt.alias("y"),
        F.expr(
            "x.k = y.k AND x.sk < y.sk AND x.effective_start_date < "
            "coalesce(y.effective_end_date, date'9999-12-31') AND y.effective_start_date < "
            "coalesce(x.effective_end_date, date'9999-12-31')"
        ),
    )
    assert pairs.isEmpty()


@pytest.mark.parametrize("partitions", [None, 1, 32])
def test_dense_keys_do_not_depend_on_layout(spark, partitions):
    df = spark.range(1000).selectExpr("concat('k', id * 7919 % 1000) AS k", "id AS v")
    numbered = dense_sk(df.repartition(13), ["k"], "sk", start=5, partitions=partitions)
    rows = numbered.orderBy("sk").collect()
    assert [r.sk for r in rows] == list(range(5, 1005))
    assert [r.k for r in rows] == sorted(r.k for r in rows)


def test_dense_keys_of_nothing(frame):
    numbered = dense_sk(frame("k string"), ["k"], "sk")
    assert numbered.columns == ["k", "sk"] and numbered.isEmpty()


def test_initial_load_needs_no_single_partition_window(spark, frame):
    loaded = scd2_initial(frame(SCHEMA, ("C001", "UK")), ["customer_id"], ["country"], "sk", DAY1)
    assert "Window" not in loaded._jdf.queryExecution().executedPlan().toString()


def test_a_rebuild_leaves_columns_behind(frame):
    """Only what is kept is numbered and written; versions are those of the whole feed."""
    rows = [("1", "a", "x", "2026-01-01", 1), ("1", "a", "y", "2026-01-02", 2),
            ("1", "b", "x", "2026-01-02", 3), ("2", "a", "x", "2026-01-02", 4), ("10", None, "x", "2026-01-02", 5)]
    feed = frame("id string, kind string, other string, day date, n int", *rows)
    options = (["id"], ["kind"], "sk", "day", ["n"])
    whole = scd2_rebuild(feed, *options)
    narrow = scd2_rebuild(feed.withColumn("id", F.col("id").cast("bigint")), *options, keep=[],
                          order_by=[START, F.col("id").cast("string")])
    assert narrow.columns == ["id", START, "effective_end_date", "is_current", "sk"]
    shown = [F.col("id").cast("string"), START, "effective_end_date", "is_current", "sk"]
    assert as_rows(narrow, *shown) == as_rows(whole, *shown) and narrow.count() == 4
    assert scd2_rebuild(feed, *options, keep=["kind"]).columns == ["id", "kind", *narrow.columns[1:], "_row_hash"]
