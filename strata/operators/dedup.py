"""Keep the latest row per business key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Up to so many repeated keys, about as much as Spark broadcasts by default, their rows are told apart
#: from the others in place; beyond it all rows are shuffled by key.
FEW_REPEATED = 200_000


def dedup_latest(
    df: DataFrame,
    key: list[str],
    latest: list[str | Column],
    tie_break: list[str] | None = None,
) -> DataFrame:
    """One row per key: the greatest by ``latest``, then by ``tie_break``.

    ``latest`` entries are column names (newest first) or ready-made sort columns. Without a
    tie-break all remaining columns decide in order, so the pick never depends on layout.
    The ``row_number() = 1`` form lets Spark keep one row per key and map task before the
    shuffle, so a key that holds much of the table reaches its reducer as a few rows only.
    """
    named = [c for c in latest if isinstance(c, str)]
    if tie_break is None:
        tie_break = [c for c in df.columns if c not in key and c not in named]
    order = [c if isinstance(c, Column) else F.desc_nulls_last(c) for c in latest]
    order += [F.desc_nulls_last(c) for c in tie_break]
    newest_first = Window.partitionBy(*key).orderBy(*order)
    return (
        df.withColumn("_recency", F.row_number().over(newest_first))
        .where(F.col("_recency") == 1)
        .drop("_recency")
    )


def dedup_mostly_unique(
    df: DataFrame, key: list[str], latest: list[str | Column], tie_break: list[str] | None = None
) -> tuple[DataFrame, int]:
    """``dedup_latest`` for rows whose keys seldom come twice, and how many rows there are.

    The rows are counted by a hash of their key first, which shuffles two numbers of each row. Rows
    whose hash comes once stay where they are; only the others are shuffled whole. Different keys of
    one hash are among them, which costs a little and changes nothing. The rows are read twice.
    """
    seen = F.xxhash64(*key)
    counted = df.groupBy(seen.alias("_seen")).agg(F.count(F.lit(1)).alias("_n"))
    found = counted.agg(F.sum("_n").alias("rows"), F.count_if(F.col("_n") > 1).alias("repeated")).first()
    rows = found["rows"] or 0
    if not found["repeated"]:
        return df, rows
    if found["repeated"] > FEW_REPEATED:
        return dedup_latest(df, key, latest, tie_break), rows
    repeated = F.broadcast(counted.where(F.col("_n") > 1).select("_seen"))
    once, more = (
        df.withColumn("_seen", seen).join(repeated, "_seen", how).select(*df.columns)
        for how in ("left_anti", "left_semi")
    )
    return once.unionByName(dedup_latest(more, key, latest, tie_break)), rows
