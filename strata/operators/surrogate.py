"""Dense, layout-independent surrogate keys without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.session import materialize

_ROW_BITS = 33  # monotonically_increasing_id(): partition number above, row number below


def dense_sk(
    df: DataFrame,
    order_by: list[str | Column],
    name: str,
    start: int = 0,
    partitions: int | None = None,
) -> DataFrame:
    """Number the rows ``start, start + 1, ...`` in the order of ``order_by``.

    The rows are range-partitioned and sorted, each row's place inside its partition is written
    down with it, and the partition sizes (one number per partition) give the offsets.
    ``order_by`` has to be unique for the numbering to be reproducible. Range bounds use all the
    order columns, so many rows that share the first one are still spread over partitions.
    """
    spread = (
        df.repartitionByRange(partitions, *order_by)
        if partitions
        else df.repartitionByRange(*order_by)
    )
    placed = materialize(
        spread.sortWithinPartitions(*order_by).withColumn(
            "_place", F.monotonically_increasing_id()
        )
    )
    part = F.shiftright("_place", _ROW_BITS).cast("int")
    row = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    sizes = dict(placed.groupBy(part.alias("p")).count().collect())
    offsets, total = [], start
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(total)
        total += sizes.get(p, 0)
    if not offsets:
        return placed.withColumnRenamed("_place", name)
    offset = F.element_at(F.lit(offsets).cast("array<bigint>"), part + 1)
    return placed.withColumn(name, offset + row).drop("_place")


def stable_sk(
    df: DataFrame,
    key: list[str],
    name: str,
    previous: DataFrame | None = None,
    first: int | None = None,
) -> DataFrame:
    """Number the rows like ``dense_sk``, but let keys numbered in ``previous`` keep their number.

    ``df`` and ``previous`` have one row per key; new keys are numbered from ``first`` on, by
    default above the greatest of ``previous``. A caller that drops rows passes its own ``first``,
    so that no number is given twice.
    """
    if previous is None:
        return dense_sk(df, list(key), name, first or 0)
    known = previous.select(*key, name)
    if first is None:
        first = known.agg(F.coalesce(F.max(name) + 1, F.lit(0))).first()[0]
    fresh = dense_sk(df.join(known, key, "left_anti").select(*df.columns), list(key), name, first)
    return df.join(known, key).select(*df.columns, name).unionByName(fresh)
