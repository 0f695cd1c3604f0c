"""Type-2 history: detect changes, close old versions, open new ones, rebuild from scratch."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.columns import any_differs, open_end, row_hash
from strata.operators.dedup import dedup_latest
from strata.operators.surrogate import dense_sk
from strata.session import materialize

# The columns that history adds to a table.
HASH = "_row_hash"
START = "effective_start_date"
END = "effective_end_date"
CURRENT = "is_current"


def current_versions(history: DataFrame) -> DataFrame:
    return history.where(F.col(CURRENT))


def version_history(history: DataFrame, key: list[str]) -> DataFrame:
    """All versions with their number per key, oldest first."""
    oldest_first = Window.partitionBy(*key).orderBy(START, F.asc_nulls_last(END))
    return history.withColumn("version", F.row_number().over(oldest_first))


def _open_versions(
    df: DataFrame,
    tracked: list[str],
    sk: str,
    start: Column,
    order_by: list[str | Column],
    first_sk: int = 0,
    end: Column | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """The rows as versions with surrogate keys from ``first_sk`` on, in ``order_by`` order.

    ``keep`` names the columns of ``df`` that go on, by default all. The hash is added after the
    numbering, which reads its input twice; without all tracked columns there is none.
    """
    end = (F.lit(None) if end is None else end).cast("date")
    dated = df.withColumns({START: start.cast("date"), END: end}).withColumn(
        CURRENT, F.col(END).isNull()
    )
    if keep is not None:
        dated = dated.select(*keep, START, END, CURRENT)
    numbered = dense_sk(dated, order_by, sk, first_sk)
    return numbered.withColumn(HASH, row_hash(tracked)) if set(tracked) <= set(numbered.columns) else numbered


def scd2_initial(
    source: DataFrame,
    key: list[str],
    tracked: list[str],
    sk: str,
    as_of: dt.date,
    initial_start: dt.date | None = None,
) -> DataFrame:
    """First load: every row is current from ``initial_start`` (default: the load day) on."""
    return _open_versions(source, tracked, sk, F.lit(initial_start or as_of), list(key))


def scd2_diff(
    source: DataFrame, current: DataFrame, key: list[str], tracked: list[str]
) -> DataFrame:
    """Source rows whose key is new or whose tracked values differ from the current version.

    Values are compared column by column with NULL-safe equality, so neither NULLs nor
    separators inside values can hide a change. ``current`` has one row per key.
    """
    known = current.select(*key, *tracked, F.lit(True).alias("_known"))
    matched = [F.col(f"s.{k}") == F.col(f"t.{k}") for k in key]
    return (
        source.alias("s")
        .join(known.alias("t"), matched, "left")
        .where(F.col("t._known").isNull() | any_differs("s", "t", tracked))
        .select("s.*")
    )


@dataclass(frozen=True)
class HistoryChange:
    """The effect of one batch on a history table.

    ``opened`` are the new versions, ``closed`` the versions they end, ``kept`` the current
    versions that stay. Versions closed earlier are not part of it: no batch changes them.
    """

    opened: DataFrame
    closed: DataFrame
    kept: DataFrame


def scd2_change(
    source: DataFrame,
    current: DataFrame,
    key: list[str],
    tracked: list[str],
    sk: str,
    as_of: dt.date,
    next_sk: int,
) -> HistoryChange | None:
    """What a batch changes, or ``None`` if it changes nothing.

    ``source`` is unique on the key; keys that are missing from it stay as they are. A batch dated
    before the newest current version is refused; ``scd2_splice`` puts it into its place.
    """
    newest = current.agg(F.max(START)).first()[0]
    if newest is not None and newest > as_of:
        raise ValueError(f"a batch as of {as_of} cannot change a version that starts on {newest}")
    fresh = scd2_diff(source, current, key, tracked)
    opened = _open_versions(fresh, tracked, sk, F.lit(as_of), list(key), next_sk)
    if opened.isEmpty():
        return None
    changed = opened.select(*key)
    closed = current.join(changed, key, "left_semi").withColumns(
        {END: F.lit(as_of), CURRENT: F.lit(False)}
    )
    kept = current.join(changed, key, "left_anti")
    return HistoryChange(opened, closed.select(*current.columns), kept.select(*current.columns))


def next_surrogate(history: DataFrame, sk: str) -> int:
    return history.agg(F.coalesce(F.max(sk) + 1, F.lit(0))).first()[0]


def scd2_merge(
    source: DataFrame,
    target: DataFrame | None,
    key: list[str],
    tracked: list[str],
    sk: str,
    as_of: dt.date,
    initial_start: dt.date | None = None,
) -> DataFrame:
    """The whole history table after one batch; the target itself if nothing changed.

    Publish or materialize the result before merging the next batch: the plan reads the target
    several times, so a chain of unwritten merges would grow with every step.
    """
    if target is None:
        return scd2_initial(source, key, tracked, sk, as_of, initial_start)
    change = scd2_change(
        source, current_versions(target), key, tracked, sk, as_of, next_surrogate(target, sk)
    )
    if change is None:
        return target
    earlier = target.where(~F.col(CURRENT))
    return (
        earlier.unionByName(change.closed).unionByName(change.kept).unionByName(change.opened)
    )


def scd2_splice(
    late: DataFrame,
    versions: DataFrame,
    later: DataFrame,
    day: str,
    key: list[str],
    tracked: list[str],
    sk: str,
    as_of: dt.date,
    next_sk: int,
) -> DataFrame:
    """The histories of the keys of a late batch, with the batch in its place.

    ``late`` is unique on the key and holds what was reported on ``as_of``; ``versions`` are all
    versions of its keys, and ``later`` names the days (column ``day``) after ``as_of`` on which a key was
    reported. The result is what merging all batches in their order would have given: the late
    values count until the key's next report, on which the version that was there comes back or, if
    it has the same values, goes on. On a day that has a version already, the late batch counts as
    the newer one. Versions that keep start and values keep their surrogate key; the others are
    numbered from ``next_sk`` on.
    """
    own = [START, END, CURRENT, HASH, sk]
    values = [c for c in versions.columns if c not in own]
    points = versions.select(*values, F.col(START).alias("_day"), F.col(sk).alias("_old"), F.lit(1).alias("_rank"))
    spliced = late.select(*values, F.lit(as_of).alias("_day"), F.lit(None).cast("bigint").alias("_old"),
                          F.lit(2).alias("_rank"))
    following = (
        later.where(F.col(day) > F.lit(as_of)).join(late.select(*key), key, "left_semi")
        .groupBy(*key).agg(F.min(day).alias("_next"))
    )
    on = [F.col(f"v.{k}") == F.col(f"n.{k}") for k in key]
    live = (F.col(f"v.{START}") <= F.col("n._next")) & (F.col("n._next") < open_end(F.col(f"v.{END}")))
    again = versions.alias("v").join(following.alias("n"), [*on, live]).select(
        *[f"v.{c}" for c in values], F.col("n._next").alias("_day"),
        F.lit(None).cast("bigint").alias("_old"), F.lit(0).alias("_rank"),
    )
    # On one day the late batch comes first, then what is there, then what comes back. If the late
    # batch says what is there, what is there stays as it is.
    same_day = Window.partitionBy(*key, "_day").orderBy(F.desc("_rank"))
    said = row_hash(tracked)
    chosen = (
        points.unionByName(spliced).unionByName(again).withColumn(HASH, said)
        .withColumns({"_nth": F.row_number().over(same_day), "_below": F.lead(F.struct("_old", HASH)).over(same_day)})
        .where("_nth = 1")
        .withColumn("_old", F.when(F.col("_old").isNull() & (F.col("_below")[HASH] == F.col(HASH)),
                                   F.col("_below")["_old"]).otherwise(F.col("_old")))
    )
    by_day = Window.partitionBy(*key).orderBy("_day")
    changes = chosen.withColumn("_was", F.lag(HASH).over(by_day)).where(
        F.col("_was").isNull() | (F.col("_was") != F.col(HASH))
    )
    dated = changes.select(
        *values, HASH, "_old", F.col("_day").alias(START), F.lead("_day").over(by_day).cast("date").alias(END)
    ).withColumn(CURRENT, F.col(END).isNull())
    dated = materialize(dated)
    kept = dated.where("_old IS NOT NULL").withColumn(sk, F.col("_old"))
    fresh = dense_sk(dated.where("_old IS NULL"), [START, *key], sk, next_sk)
    return kept.unionByName(fresh).select(*versions.columns)


def scd2_rebuild(
    feed: DataFrame,
    key: list[str],
    tracked: list[str],
    sk: str,
    day: str,
    latest: list[str | Column],
    tie_break: list[str] | None = None,
    initial_start: dt.date | None = None,
    keep: list[str] | None = None,
    order_by: list[str | Column] | None = None,
) -> DataFrame:
    """The history that daily ``scd2_merge`` runs over the feed would have built.

    The feed is cut to one row per key and day first; that step is partitioned by both, so a
    key with much of the feed is spread over its days, and what is left of a key is at most one
    row per day. ``initial_start`` dates the versions of the first day back, as a first load does.

    ``keep`` names the columns besides the key that the versions carry, by default all of the feed.
    The others are left behind at the first step that does not need them, so that they are neither
    shuffled nor written. Versions are numbered in the order of ``order_by``, by default start and key.
    """
    daily = dedup_latest(feed, [*key, day], latest, tie_break)
    kept = None
    if keep is not None:
        kept = [c for c in feed.columns if c in key or c in keep]
        daily = daily.select(*[c for c in feed.columns if c in kept or c in tracked or c == day])
    by_day = Window.partitionBy(*key).orderBy(day)
    before = {f"_was_{i}": F.lag(c).over(by_day) for i, c in enumerate(tracked)}
    same = F.col("_nth") > 1
    for i, c in enumerate(tracked):
        same = same & F.col(c).eqNullSafe(F.col(f"_was_{i}"))
    changes = (
        daily.withColumns({"_nth": F.row_number().over(by_day), **before})
        .where(~same)
        .drop("_nth", *before)
    )
    versions = _open_versions(
        changes, tracked, sk, F.col(day), order_by or [START, *key], end=F.lead(day).over(by_day), keep=kept
    )
    if initial_start is None:
        return versions
    first_day = versions.agg(F.min(START)).first()[0]
    return versions.withColumn(
        START, F.when(F.col(START) == F.lit(first_day), F.lit(initial_start)).otherwise(F.col(START))
    )
