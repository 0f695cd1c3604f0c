"""Which rows of a source layer still have to be processed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INGEST_DATE = "_ingest_date"
BATCH_ID = "_batch_id"


def read_incremental(
    source: DataFrame, target: DataFrame | None, column: str = INGEST_DATE
) -> DataFrame:
    """Rows newer than the target's greatest ``column``; all rows if there is none.

    The watermark is one value, read first, so that the filter is a literal and prunes the
    source's partitions. Being a strict comparison on a date, it skips a second batch of a day
    that was already processed; ``unprocessed_batches`` does not.
    """
    if target is None:
        return source
    watermark = target.agg(F.max(column)).first()[0]
    if watermark is None:
        return source
    return source.where(F.col(column) > F.lit(watermark))


def unprocessed_batches(
    source: DataFrame, ledger: DataFrame, column: str = BATCH_ID
) -> DataFrame:
    """Rows of batches that are not listed in the ledger of processed batches."""
    return source.join(ledger.select(column).distinct(), column, "left_anti")
