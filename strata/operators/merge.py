"""Key-based upsert as a DataFrame transform."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class DuplicateKeys(ValueError):
    """The source holds several rows for one business key."""


def require_unique(df: DataFrame, key: list[str]) -> None:
    """Fail if a key occurs twice. Counts are pre-aggregated per map task."""
    repeated = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    example = repeated.first()
    if example is not None:
        raise DuplicateKeys(f"source rows are not unique on {key}, e.g. {example.asDict()}")


def newer_than_target(
    source: DataFrame, target: DataFrame, key: list[str], column: str
) -> DataFrame:
    """Source rows that are new or at least as recent as the target row of their key."""
    known = target.select(*key, F.col(column).alias("_target_recency"))
    return (
        source.join(known, key, "left")
        .where(F.col("_target_recency").isNull() | (F.col(column) >= F.col("_target_recency")))
        .select(*source.columns)
    )


def merge_upsert(
    source: DataFrame,
    target: DataFrame | None,
    key: list[str],
    newer_than: str | None = None,
    check_unique: bool = True,
) -> DataFrame:
    """The target after an upsert: source rows replace matched keys, others are added.

    Target rows without a source row stay. NULL key parts never match. With ``newer_than`` an
    older source row does not replace a more recent target row. Pass ``check_unique=False`` when
    the source was just deduplicated on the key, to save the check's pass.
    """
    if check_unique:
        require_unique(source, key)
    if target is None:
        return source
    if newer_than:
        source = newer_than_target(source, target, key, newer_than)
    untouched = target.join(source.select(*key), key, "left_anti").select(*target.columns)
    return untouched.unionByName(source)
