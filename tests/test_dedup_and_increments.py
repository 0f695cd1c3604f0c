import datetime as dt

from rows import as_rows

from strata.operators import dedup
from strata.operators.dedup import dedup_latest, dedup_mostly_unique
from strata.operators.incremental import read_incremental, unprocessed_batches


def test_latest_row_of_a_fact_key(frame):
    df = frame(
        "invoice_id string, stock_code string, quantity bigint, _ingest_ts string",
        ("INV001", "A100", 5, "2026-01-01T10:00:00"),
        ("INV001", "A100", 7, "2026-01-01T14:00:00"),
    )
    kept = dedup_latest(df, ["invoice_id", "stock_code"], ["_ingest_ts"])
    assert as_rows(kept, "quantity") == [(7,)]
    assert kept.columns == df.columns


def test_latest_row_of_a_dimension_key(frame):
    df = frame(
        "customer_id string, country string, _ingest_ts string",
        ("C001", "UK", "2026-01-01T06:00:00"),
        ("C001", "Germany", "2026-01-01T18:00:00"),
    )
    assert as_rows(dedup_latest(df, ["customer_id"], ["_ingest_ts"]), "country") == [("Germany",)]


def test_ties_do_not_depend_on_layout(frame):
    rows = [("k", f"v{i}", "same") for i in range(50)]
    df = frame("k string, v string, ts string", *rows)
    picks = {
        dedup_latest(df.repartition(n, "v"), ["k"], ["ts"]).first().v for n in (1, 2, 7, 32)
    }
    assert picks == {"v9"}


def test_a_hot_key_is_cut_before_the_shuffle(spark):
    """Each map task sends at most one row per key: the partial group limit is in the plan."""
    df = spark.range(1000).selectExpr("id % 2 AS k", "id AS v")
    plan = dedup_latest(df, ["k"], ["v"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_only_rows_of_repeated_keys_are_shuffled(frame, monkeypatch):
    """The same rows as ``dedup_latest``, NULL keys too, with few and with many repeated keys."""
    df = frame(
        "k string, part int, v bigint, ts string",
        ("a", 1, 5, "10"), ("a", 1, 7, "14"), ("a", 2, 1, "10"), ("b", None, 2, "10"), ("b", None, 3, "10"),
        (None, None, 4, "10"), (None, None, 4, "10"), (None, 1, 6, None), ("c", 1, 8, "10"), ("c", 1, 9, None),
    )
    key, whole = ["k", "part"], as_rows(dedup_latest(df, ["k", "part"], ["ts"]))
    for few in (dedup.FEW_REPEATED, 0):
        monkeypatch.setattr(dedup, "FEW_REPEATED", few)
        kept, rows = dedup_mostly_unique(df, key, ["ts"])
        assert rows == 10 and kept.columns == df.columns and as_rows(kept) == whole
    unique, rows = dedup_mostly_unique(df.where("k = 'a' AND v <> 5"), key, ["ts"])
    assert rows == 2 and "Exchange" not in unique._jdf.queryExecution().executedPlan().toString()
    empty, rows = dedup_mostly_unique(df.where("k = 'z'"), key, ["ts"])
    assert rows == 0 and as_rows(empty) == []


def test_watermark(frame):
    source = frame(
        "id int, _ingest_date date", (1, "2026-01-01"), (2, "2026-01-02"), (3, "2026-01-03")
    )
    target = frame("id int, _ingest_date date", (1, "2026-01-01"), (2, "2026-01-02"))
    assert as_rows(read_incremental(source, target), "id") == [(3,)]
    assert read_incremental(source, None).count() == 3
    assert read_incremental(source, target.limit(0)).count() == 3


def test_second_batch_of_a_day_is_found_by_batch_only(frame):
    source = frame(
        "id int, _ingest_date date, _batch_id string",
        (1, "2026-01-01", "a"), (2, "2026-01-01", "b"),
    )
    target = source.where("_batch_id = 'a'")
    assert read_incremental(source, target).count() == 0
    assert as_rows(unprocessed_batches(source, target), "id") == [(2,)]


def test_watermark_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).selectExpr(
        "id", "date_add(date'2026-01-01', cast(id as int)) AS _ingest_date"
    ).write.partitionBy("_ingest_date").parquet(path)
    source = spark.read.parquet(path)
    fresh = read_incremental(source, source.where(source._ingest_date <= dt.date(2026, 1, 8)))
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_ingest_date" in plan
    assert fresh.count() == 2
