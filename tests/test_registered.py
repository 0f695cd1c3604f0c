"""Every registered query against its SQL counterpart on the smallest given tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point
from strata.plans.oracle import ORACLE
from strata.plans.registered import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="given tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def by_name(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(ORACLE) <= set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    found = QUERIES[name](spark, FOLDER)
    result = duck.execute(ORACLE[name])
    expected, described = result.fetchall(), result.description
    types = {d[0]: str(d[1]) for d in described}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in found.schema} == types
    assert by_name(map(tuple, found.collect()), found.columns) == by_name(
        expected, [d[0] for d in described]
    )
    plan = found._jdf.queryExecution().executedPlan().toString()
    for slow in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert slow not in plan


def test_flagship(spark):
    result = entry_point.entry(spark)
    assert result.columns == ["country", "revenue"] and result.count() > 0
