"""A pipeline over ``documents``: filter, deduplicate, decontaminate, redact, tokenise.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; ``run`` writes every result but
the last as Parquet to the shared folder and reads it back for the next stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import bpe, decontaminate, pii, simhash, toxicity
from strata.llm.common import fold, table, unused
from strata.session import materialize

TOXIC_FROM = 0.3
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Workers of the stages before have grown already.
BPE_CACHE_BYTES = 28 << 20


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below TOXIC_FROM; trained on the labelled ones among them."""
    train = fold("doc_id", 4) != 2
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"), train)
    out = unused(docs, "_toxicity")
    scored = toxicity.score_toxicity(docs, model, out=out)
    return scored.where(F.col(out) < TOXIC_FROM).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that with the smallest id."""
    return simhash.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item, each row judged by its own text, with an id or not."""
    row = unused(docs, "_row")
    both_ways = F.concat_ws(" ", F.xxhash64("doc_id", "text"), F.xxhash64("text", F.lit(1), "doc_id"))
    rows = docs.withColumn(row, both_ways)
    found = decontaminate.contaminated(rows, table(spark, sf_dir, "benchmark"), key=row)
    return rows.join(found.select(row).distinct(), row, "left_anti").select(*docs.columns)


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text."""
    spans = unused(docs, "_personal")
    out = pii.redact(pii.find_personal(docs, out=spans), spans=spans).drop(spans)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = F.when(F.col("text").isNotNull(), F.length("text").cast(kind))
        out = out.withColumn("n_chars", F.coalesce(changed, "n_chars"))
    return out.select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of every document, their number, and whether they decode to its text."""
    ids, text = unused(docs, "_ids"), unused(docs, "_decoded")
    decoded = bpe.encode_and_decode(
        docs, RANKS, public_tokenizers.PATTERN, ids=ids, out=text, cache_bytes=BPE_CACHE_BYTES
    )
    whole = F.coalesce("text", F.lit("")).cast("binary")
    return decoded.select(
        *[c for c in docs.columns if c not in ("text", "token_ids", "n_tokens", "round_trip")],
        F.col(ids).alias("token_ids"),
        (F.length(ids) / 4).cast("long").alias("n_tokens"),
        (F.col(text) == whole).alias("round_trip"),
    )


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal),
    ("byte_bpe", tokenise),
]

#: SQL can express neither the trained stages nor the tokeniser.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
