"""Landing files as a stream: each micro-batch is one bronze batch."""

from __future__ import annotations

import datetime as dt
import threading
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from strata.plans.layers import (
    next_ingest_ts,
    refine_dimension,
    refine_fact,
    run_gold,
    store_bronze,
)
from strata.sources.landing import CORRUPT, SOURCE_FILE, tag_metadata
from strata.sources.tables import Tables
from strata.spec import TableSpec


def stream_landing(
    tables: Tables, spec: TableSpec, landing: str, files_at_once: int | None = None
) -> DataFrame:
    """The landing folder as a streaming frame with the file of each row."""
    schema = T.StructType([*spec.schema.fields, T.StructField(CORRUPT, T.StringType(), True)])
    reader = tables.spark.readStream.option("header", True)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return (
        reader.option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .schema(schema)
        .csv(landing)
        .withColumn(SOURCE_FILE, F.col("_metadata.file_path"))
    )


def stream_ingest(
    tables: Tables,
    spec: TableSpec,
    landing: str,
    checkpoint: str,
    as_of: dt.date,
    refine: bool = True,
    gold: Iterable[str] = (),
    period: str = "day",
    files_at_once: int | None = None,
) -> StreamingQuery:
    """Ingest everything that has landed, then stop; start it again to continue.

    The stream's checkpoint remembers the files. A micro-batch repeated after a failure is
    recognised in the bronze ledger, by its number and the id that its stream keeps in the
    checkpoint, and not stored twice. Another stream, or one that has lost its checkpoint, has an
    id of its own and stores what it reads; silver then keeps the latest row of each key.

    ``gold`` names gold tables to bring up to date after each micro-batch: of facts only the
    directories are rewritten that hold changed days or facts of changed keys, so a batch that
    changes nothing, as a repeated one, rewrites nothing. One stream at a time may do so.
    ``files_at_once`` bounds a micro-batch.
    """
    known = threading.Event()
    identity: list[str] = []

    def store(batch: DataFrame, number: int) -> None:
        known.wait()
        mark = f"stream-{identity[0]}-{number}"
        state = tables.published("bronze", spec.name)
        if state is None or mark not in state.consumed:
            moment = next_ingest_ts(tables, spec, as_of)
            tagged = tag_metadata(batch, mark, moment, F.col(SOURCE_FILE), as_of)
            store_bronze(tables, spec, tagged, as_of, consumed=[mark])
        if refine:
            step = refine_dimension if spec.keeps_history else refine_fact
            step(tables, spec, as_of)
        run_gold(tables, gold, incremental=True, period=period)

    query = (
        stream_landing(tables, spec, landing, files_at_once)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    identity.append(query.id)
    known.set()
    return query
