"""CSV landing files: declared schema, malformed rows, audit columns."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.session import shuffles_freed

CORRUPT = "_corrupt_record"
SOURCE_FILE = "_source_file"
INGEST_TS = "_ingest_ts"
BATCH_ID = "_batch_id"
INGEST_DATE = "_ingest_date"
AUDIT_COLUMNS = (SOURCE_FILE, INGEST_TS, BATCH_ID, INGEST_DATE)


def read_landing(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    on_bad: str = "quarantine",
) -> DataFrame:
    """CSV with a header, read with the declared schema.

    Headers are checked against the schema, so a reordered file is an error instead of a silent
    mix-up. ``on_bad="quarantine"`` keeps malformed rows, with their text in ``_corrupt_record``;
    ``on_bad="fail"`` fails the job on the first one, whichever columns are asked for.
    """
    reader = spark.read.option("header", True).option("enforceSchema", False)
    if on_bad == "fail":
        rows = reader.option("mode", "FAILFAST").schema(schema).csv(path)
        # CSV cells are converted only for columns a query needs. This filter is always true but
        # needs them all.
        return rows.where(F.xxhash64(*schema.names) >= F.lit(-(2**63)))
    if on_bad != "quarantine":
        raise ValueError("on_bad must be 'quarantine' or 'fail'")
    return (
        reader.option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .schema(T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType(), True)]))
        .csv(path)
    )


def tag_metadata(
    df: DataFrame,
    batch_id: str | None = None,
    ingest_ts: dt.datetime | None = None,
    source: str | Column | None = None,
    ingest_date: dt.date | None = None,
) -> DataFrame:
    """Add the four audit columns, the same literals for all rows of a run.

    ``_source_file`` is the file a row was read from, unless ``source`` says otherwise;
    ``_ingest_date`` is the day of ``ingest_ts``, unless ``ingest_date`` is given.
    """
    moment = ingest_ts or dt.datetime.now(dt.timezone.utc)
    if source is None:
        source = F.col("_metadata.file_path")
    file = source if isinstance(source, Column) else F.lit(source)
    return df.withColumns(
        {
            SOURCE_FILE: file,
            INGEST_TS: F.lit(moment.isoformat(timespec="microseconds") if ingest_date else moment.isoformat()),
            BATCH_ID: F.lit(batch_id or str(uuid.uuid4())),
            INGEST_DATE: F.lit(ingest_date or moment.date()),
        }
    )


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below a landing path with their modification time; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select(F.col("path").alias(SOURCE_FILE), F.col("modificationTime").alias("modified"))
    )


def export_landing(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a frame as compressed CSV with a header, readable by ``read_landing``.

    A file is read by one task, as it was written by one.
    """
    with shuffles_freed(df.sparkSession):
        df.write.mode(mode).option("header", True).option("compression", "gzip").csv(path)
