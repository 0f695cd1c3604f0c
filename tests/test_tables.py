import datetime as dt
import time
from pathlib import Path
from urllib.parse import unquote

import pytest
from rows import as_rows
from pyspark.sql import functions as F

from strata.session import FREE_SHUFFLES, materialize, release, shuffles_freed
from strata.sources.catalog import CatalogTables
from strata.sources.landing import CORRUPT, export_landing, read_landing
from strata.sources.tables import touched_directories

SCHEMA = "k string, v int, day date"
ROWS = [("a", 1, "2026-01-01"), ("b", 2, "2026-01-02"), ("c", 3, "2026-01-02")]


def test_publish_append_read(tables, frame):
    assert not tables.exists("silver", "t")
    with pytest.raises(FileNotFoundError, match="silver.t"):
        tables.read("silver", "t")
    tables.write(frame(SCHEMA, *ROWS), "silver", "t", partition_by=["day"])
    tables.append(frame(SCHEMA, ("d", 4, "2026-01-01")), "silver", "t", partition_by=["day"])
    assert tables.list("silver") == ["t"]
    found = tables.read("silver", "t")
    assert found.columns == ["k", "v", "day"] and found.schema["day"].dataType.simpleString() == "date"
    assert as_rows(found, "k") == [("a",), ("b",), ("c",), ("d",)]
    tables.write(frame(SCHEMA, ("z", 0, "2026-01-05")), "silver", "t", partition_by=["day"])
    assert as_rows(tables.read("silver", "t"), "k") == [("z",)]


def test_a_write_may_read_the_table_it_replaces(tables, frame):
    tables.write(frame(SCHEMA, *ROWS), "silver", "t")
    doubled = tables.read("silver", "t").withColumn("v", F.col("v") * 2)
    before = tables.read("silver", "t")
    tables.write(doubled, "silver", "t")
    assert as_rows(tables.read("silver", "t"), "v") == [(2,), (4,), (6,)]
    assert as_rows(before, "v") == [(1,), (2,), (3,)]  # readers of the old state are not disturbed


def test_partition_filters_reach_the_scan(tables, frame):
    for _ in range(2):
        tables.append(frame(SCHEMA, *ROWS), "silver", "t", partition_by=["day"])
    found = tables.read("silver", "t").where(F.col("day") == F.lit(dt.date(2026, 1, 1))).select("k")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "ReadSchema: struct<k:string>" in plan
    assert found.count() == 2


def test_whole_generations_are_named_once(tables, frame):
    tables.write(frame(SCHEMA, *ROWS), "silver", "t", partition_by=["day"])
    state = tables.published("silver", "t")
    assert len(state.dirs) == 2 and state.paths(list(state.dirs)) == [f"{state.base}/_gen=1"]
    tables.replace_partition(None, "silver", "t", "day", "2026-01-01")
    state = tables.published("silver", "t")
    assert state.paths(list(state.dirs)) == [f"{state.base}/_gen=1/day=2026-01-02"]


def test_replace_partition(tables, frame):
    tables.write(frame(SCHEMA, *ROWS), "silver", "t", partition_by=["day"])
    tables.replace_partition(
        frame(SCHEMA, ("n", 9, "2026-01-02")), "silver", "t", "day", dt.date(2026, 1, 2)
    )
    assert as_rows(tables.read("silver", "t"), "k") == [("a",), ("n",)]
    with pytest.raises(ValueError, match="not partitioned"):
        tables.replace_partition(None, "silver", "t", "k", "a")


def test_only_directories_with_a_key_are_touched(tables, frame):
    tables.write(frame(SCHEMA, *ROWS), "silver", "t", partition_by=["day"])
    source = frame(SCHEMA, ("b", 9, "2026-01-09"), ("new", 1, "2026-01-09"))
    rows = tables.read("silver", "t", with_directory=True)
    assert touched_directories(rows, source, ["k"]) == {"_gen=1/day=2026-01-02"}
    assert touched_directories(rows, source, ["k", "day"], ["day"]) == set()


def test_partition_values_with_special_characters(tables, frame):
    df = frame("k string, place string", ("a", "x/y z:1%"), ("b", "plain"), ("c", None))
    tables.write(df, "silver", "t", partition_by=["place"])
    assert as_rows(tables.read("silver", "t")) == as_rows(df)
    rows = tables.read("silver", "t", with_directory=True)
    touched = touched_directories(rows, df.where("k <> 'b'"), ["k"])
    assert touched < set(tables.published("silver", "t").dirs) and len(touched) == 2


def test_ledger_is_published_with_the_data(tables, frame):
    tables.write(frame(SCHEMA, *ROWS), "silver", "t", consumed=["_gen=1"])
    tables.mark_consumed("silver", "t", ["_gen=2", "_gen=1"])
    assert tables.published("silver", "t").consumed == ("_gen=1", "_gen=2")
    assert tables.read("silver", "t").count() == 3


def test_split_write(tables, frame):
    df = frame("k string, ok boolean", ("a", True), ("b", False))
    where = {"accepted": ("bronze", "t"), "rejected": ("quarantine", "t")}
    tables.write_split(df, "ok", **where, metrics=[F.count(F.lit(1)).alias("n")])
    assert as_rows(tables.read("bronze", "t")) == [("a",)]
    assert as_rows(tables.read("quarantine", "t")) == [("b",)]
    tables.write_split(df.where("ok"), "ok", **where)
    assert tables.read("bronze", "t").count() == 2 and tables.read("quarantine", "t").count() == 1
    tables.write_split(df.where("k = 'none'"), "ok", **where)
    assert tables.read("bronze", "t").count() == 2


def test_empty_tables_can_be_read(tables, frame):
    tables.write(frame(SCHEMA), "silver", "t", partition_by=["day"])
    assert tables.read("silver", "t").isEmpty()
    assert tables.read("silver", "t", with_directory=True).columns[-1] == "_directory"


def test_other_columns_cannot_be_appended(tables, frame):
    tables.write(frame(SCHEMA, *ROWS), "silver", "t")
    with pytest.raises(ValueError, match="differ"):
        tables.append(frame("k string"), "silver", "t")


def test_prune(tables, frame):
    for _ in range(3):
        tables.write(frame(SCHEMA, *ROWS), "silver", "t")
    assert tables.prune("silver", "t") == ["_gen=1", "_gen=2"]
    assert tables.read("silver", "t").count() == 3


def test_catalog(spark, frame):
    catalog = CatalogTables(spark, "test_catalog_")
    catalog.init(["silver"])
    try:
        assert not catalog.exists("silver", "t")
        catalog.append(frame(SCHEMA, *ROWS), "silver", "t", ["day"])
        catalog.append(frame(SCHEMA, ("d", 4, "2026-01-01")), "silver", "t", ["day"])
        assert catalog.list("silver") == ["t"] and catalog.read("silver", "t").count() == 4
        catalog.publish(catalog.read("silver", "t").where("v > 1"), "silver", "t")
        assert as_rows(catalog.read("silver", "t"), "k") == [("b",), ("c",), ("d",)]
        assert spark.sql("SELECT sum(v) FROM test_catalog_silver.t").first()[0] == 9
        catalog.replace_partition(
            frame(SCHEMA, ("n", 7, "2026-01-02")), "silver", "t", "day", dt.date(2026, 1, 2)
        )
        assert as_rows(catalog.read("silver", "t"), "k") == [("d",), ("n",)]
    finally:
        catalog.drop("silver")
    assert not catalog.exists("silver", "t")


def test_catalog_keeps_partitions_and_drops_old_versions(spark, frame):
    catalog = CatalogTables(spark, "test_parts_")
    catalog.init(["silver"])
    try:
        catalog.publish(frame(SCHEMA, *ROWS), "silver", "t", ["day"])
        for _ in range(3):
            catalog.publish(catalog.read("silver", "t"), "silver", "t")
        assert catalog.partition_columns("silver", "t") == ["day"]
        stored = {t.name for t in spark.catalog.listTables("test_parts_silver")}
        assert stored == {"t", "t__3", "t__4"}
        day = dt.date(2026, 1, 2)
        others = catalog.read("silver", "t").where(F.col("day") == F.lit(day)).withColumn("v", F.col("v") * 10)
        catalog.replace_partition(others, "silver", "t", "day", day)
        assert as_rows(catalog.read("silver", "t"), "k", "v") == [("a", 1), ("b", 20), ("c", 30)]
        catalog.replace_partition(None, "silver", "t", "day", day)
        assert as_rows(catalog.read("silver", "t"), "k") == [("a",)]
        assert {t.name for t in spark.catalog.listTables("test_parts_silver")} == stored
    finally:
        catalog.drop("silver")


def test_released_steps_are_gone(spark, frame):
    kept = materialize(frame(SCHEMA, *ROWS))
    files = [f.removeprefix("file://") for f in kept.inputFiles()]
    assert files and all(Path(f).exists() for f in files)
    release(spark)
    assert not any(Path(f).exists() for f in files)


def test_directories_of_rows_need_no_pattern(frame, tables):
    """The directory comes from the depth of the path: a pattern for each row takes much longer."""
    rows = frame("id int, kind string, day date", (1, "a b", "2026-01-01"), (2, "x=y", "2026-01-02"), (3, None, None))
    for layout in ([], ["kind"], ["kind", "day"]):
        name = "_".join(["t", *layout])
        tables.write(rows, "silver", name, partition_by=layout)
        tables.append(rows, "silver", name, partition_by=layout)
        found = tables.read("silver", name, with_directory=True)
        assert "regexp" not in found._jdf.queryExecution().optimizedPlan().toString()
        shown = {unquote(r[0]) for r in found.select("_directory").distinct().collect()}
        assert shown == set(tables.published("silver", name).dirs)
        assert found.count() == 6


def _shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f.name for d in folders for f in Path(d.getPath()).rglob("shuffle_*.data")}


def test_a_step_leaves_no_shuffle_files_behind(spark, tmp_path):
    """They go when the step ends, not with the driver's garbage; afterwards Spark's setting is as before."""
    shuffled, before = spark.range(1000).repartition("id"), _shuffle_files(spark)
    with shuffles_freed(spark):
        with shuffles_freed(spark):
            shuffled.write.parquet(f"{tmp_path}/inner")
        shuffled.write.parquet(f"{tmp_path}/outer")
        export_landing(shuffled, f"{tmp_path}/landing")
        assert spark.conf.get(FREE_SHUFFLES) == "true"
    assert spark.conf.get(FREE_SHUFFLES, None) in (None, "false")
    for _ in range(50):  # files are deleted in the background
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert spark.read.parquet(f"{tmp_path}/inner", f"{tmp_path}/outer").count() == 2000


def test_files_are_compressed(spark, tables, tmp_path):
    """Landing files and tables take a part of the disk that plain CSV and Spark's default take."""
    rows = spark.range(5000).selectExpr("id", "cast(id % 7 as string) AS v", "CAST(NULL AS string) AS n").coalesce(1)
    export_landing(rows, f"{tmp_path}/landing")
    landed = [f for f in (tmp_path / "landing").iterdir() if f.name.startswith("part-")]
    assert landed and all(f.name.endswith(".csv.gz") for f in landed)
    back = read_landing(spark, f"{tmp_path}/landing", rows.schema).drop(CORRUPT)
    assert as_rows(back) == as_rows(rows)
    tables.write(rows, "silver", "t")
    stored = list(Path(tables.root).rglob("part-*"))
    assert stored and all(f.name.endswith(".zstd.parquet") for f in stored)
    assert as_rows(tables.read("silver", "t")) == as_rows(rows)
