"""The registered queries of this package: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import (
    bpe, decontaminate, divergence, embeddings, periodic, pii, quality, recompression, repeats,
    secrets, sharding, simhash, toxicity,
)
from strata.llm.common import fold, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


@query
def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return bpe.encode_and_decode(documents, RANKS, public_tokenizers.PATTERN).drop("text").select(
        "doc_id",
        (F.length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


@query
def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


@query
def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    found = secrets.find_secrets(documents).drop("text")
    return found.select(
        "doc_id",
        *[secrets.count_of("secrets", k).alias(f"n_{k}") for k in secrets.BASE_KINDS],
        F.sha2(secrets.spans_text("secrets", secrets.BASE_KINDS), 256).alias("base_sha256"),
        secrets.spans_text("secrets").alias("spans"),
    )


@query
def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels")
    held_out = fold("doc_id", 3) == 1
    scored = quality.score_quality(documents, labels, ~held_out).drop("text")
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    found = pii.find_personal(documents).drop("text")
    return found.select(
        "doc_id",
        *[secrets.count_of("personal", k).alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(secrets.spans_text("personal", pii.BASE_KINDS), 256).alias("base_sha256"),
        secrets.spans_text("personal").alias("spans"),
    )


SHARD_BYTES = 1 << 20


@query
def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return sharding.assign_shards(documents, SHARD_BYTES)


@query
def op8_repeats(spark: SparkSession, folder: str) -> DataFrame:
    removed = repeats.remove_repeats(table(spark, folder, "documents"))
    return removed.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    held_out = fold("doc_id", 4) == 2
    model = toxicity.train_toxicity(documents, table(spark, folder, "labels"), ~held_out)
    scored = toxicity.score_toxicity(documents, model).drop("text")
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query
def op10_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, folder, "embeddings"))


@query
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string"))
    planted = documents.withColumn("cycle", F.when(h % 10 == 0, F.floor(h / 10)).cast("bigint"))
    found = periodic.periodic_runs(planted, cycle="cycle").drop("text")
    best = periodic.strongest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    ended = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        *[best[name].alias(name) for name in ("start", "length", "period")],
        F.sha2(ended, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", "start", "length", "period",
        F.expr("1000 * length div period").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256",
    )


@query
def op12_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence(table(spark, folder, "documents"))


@query
def op13_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    removed = recompression.remove_repeated_passages(documents).drop("text")
    return removed.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE: dict[str, str] = {
    "op12_divergence": divergence.oracle(),
    "op3_decontamination": decontaminate.oracle(),
    "op7_sharding": sharding.oracle(SHARD_BYTES),
}
