"""The registered queries on the smallest given tables, and the pipeline against its parts."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strata.llm import simhash
from strata.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="given tables are not here")


@pytest.mark.parametrize("name", list(ORACLE))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    result = con.sql(ORACLE[name])
    found = QUERIES[name](spark, FOLDER)
    order = sorted(found.columns)
    assert sorted(result.columns) == order
    expected = [tuple(dict(zip(result.columns, r, strict=True))[c] for c in order) for r in result.fetchall()]
    assert sorted(map(tuple, found.select(order).collect())) == sorted(expected)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("op3_decontamination", "op12_divergence")])
def test_one_row_per_row(spark, name):
    table = "embeddings" if name.startswith("op10") else "documents"
    assert QUERIES[name](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()


def test_pipeline_round_trip(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    rows = out.select("doc_id", "round_trip", F.col("n_tokens") > 0).collect()
    assert rows and all(r[1] for r in rows) and len({r[0] for r in rows}) == len(rows)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0


def test_contaminated_rows_without_an_id_or_with_a_shared_one(spark, documents, tmp_path):
    words = [f"word{i}" for i in range(30)]
    item, clean = " ".join(words), " ".join(reversed(words))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents((None, f"before {item} after"), (None, clean), (7, item), (7, clean), (8, None), (None, None))
    kept = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert found == sorted([(None, clean), (7, clean), (8, None), (None, None)], key=repr)


def test_near_duplicates_without_ids_or_with_a_shared_one(documents, monkeypatch):
    """Fingerprints set by hand: one component of null ids two bits apart, two that share an id."""
    prints = {"a": 0b0, "b": 0b11, "c": 0b1111, "far": 0xFFFF << 20, "other": 0xFFFF << 40}
    fp = F.coalesce(*[F.when(F.col("text") == t, F.lit(v)) for t, v in prints.items()]).cast("bigint")
    monkeypatch.setattr(simhash, "with_fingerprint", lambda df, text, out: df.withColumn(out, fp))
    docs = documents((None, "a"), (None, "b"), (None, "c"), (5, "far"), (5, "other"))
    kept = simhash.without_near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.text in "abc") for r in kept) == [("5", False), ("5", False), ("None", True)]


HELPERS = ("_toxicity", "_mark", "_root", "_row", "_personal", "_ids", "_decoded", "__marks")


def test_stages_keep_columns_named_like_their_helpers(spark, tmp_path):
    given = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(30)
    docs = given.withColumns({name: F.lit(name) for name in HELPERS})
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, FOLDER).select(*HELPERS).distinct().collect()
        assert [tuple(r) for r in rows] == [HELPERS], name


@pytest.fixture
def odd_folder(spark, tmp_path):
    """Tables with null and repeated ids, odd texts, and hardly any label."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    texts = [(None, "a text without an id"), (None, None), (1, "one text"), (1, "another text"), (2, None)]
    texts += [(3, ""), (4, "漢" * 200_000), (5, "eyJ" * 50_000), (6, "\x00   😀"), (7, "7" * 50_000)]
    rows = [(i, t, None, None, None) for i, t in texts]
    odd = spark.createDataFrame(rows, docs.schema).unionByName(docs)
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet").limit(50)
    vectors.write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path), odd.count(), docs


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("op3_decontamination", "op12_divergence")])
def test_queries_on_odd_rows(spark, odd_folder, name):
    folder, many, _ = odd_folder
    assert QUERIES[name](spark, folder).count() == (50 if name.startswith("op10") else many)


def test_pipeline_and_pairs_on_odd_rows(spark, odd_folder):
    folder, many, _ = odd_folder
    assert 0 < corpus_pipeline.run(spark, folder).where("round_trip").count() <= many
    assert QUERIES["op3_decontamination"](spark, folder).count() >= 0
    assert {r.lang for r in QUERIES["op12_divergence"](spark, folder).select("lang").distinct().collect()} >= {"en"}
