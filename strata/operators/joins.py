"""Joins from facts to versioned dimensions and to other facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.columns import OPEN_END, any_null, open_end
from strata.operators.dedup import dedup_latest
from strata.operators.scd2 import END, START
from strata.session import materialize

#: Up to this many versions per key a range condition on the key join is the cheapest plan;
#: beyond it the facts' distinct (key, day) pairs are resolved first.
RANGE_JOIN_VERSIONS = 96


def pit_join(
    fact: DataFrame,
    dim: DataFrame,
    on: list[str],
    date_col: str,
    sk: str,
    closed: str = "left",
    strategy: str = "auto",
    start: str = START,
    end: str = END,
) -> DataFrame:
    """Add to each fact row the surrogate key of the version valid on the fact's own day.

    Every fact row and column stays; rows without a matching version get NULL. A NULL end is
    still open.

    ``closed="left"`` reads versions as ``[start, end)``: on the day of a change the new version
    counts. ``closed="both"`` is for data whose end is the last valid day. Where versions of a key
    overlap, a version ends at the start of the next one (of those that start together, the one
    with the greatest surrogate key counts), so a fact row is never doubled. All strategies agree.

    ``strategy`` is ``"range"`` (join on the key, range as join condition), ``"asof"`` (resolve
    the distinct (key, day) pairs of the facts in one pass over a merged timeline, then join on
    equality) or ``"auto"``, which counts the versions per key of the dimension to choose: a key
    with very many versions would otherwise be compared with every fact row of that key.
    """
    versions = _half_open(dim, on, sk, closed, start, end)
    if strategy == "auto":
        strategy = "range" if _most_versions(dim, on) <= RANGE_JOIN_VERSIONS else "asof"
        if strategy == "asof":
            fact = materialize(fact)  # read twice
    if strategy == "range":
        return _range_join(fact, versions, on, date_col, sk)
    if strategy == "asof":
        return _asof_join(fact, versions, on, date_col, sk)
    raise ValueError(f"unknown strategy {strategy!r}")


def _half_open(
    dim: DataFrame, on: list[str], sk: str, closed: str, start: str, end: str
) -> DataFrame:
    """``(key, sk, _from, _until)`` with ``_until`` exclusive and empty versions removed."""
    if closed not in ("left", "both"):
        raise ValueError("closed must be 'left' or 'both'")
    until = open_end(F.col(end))
    if closed == "both":
        until = F.when(F.col(end).isNull(), until).otherwise(F.date_add(F.col(end), 1))
    following = Window.partitionBy(*on).orderBy(start, sk)
    until = F.least(until, open_end(F.lead(start).over(following)))
    return dim.select(
        *on, F.col(sk), F.col(start).alias("_from"), until.alias("_until")
    ).where("_from < _until")


def _most_versions(dim: DataFrame, on: list[str]) -> int:
    """The most versions of any key; rows with a NULL in the key meet no fact.

    Counted in the dimension itself: its versions as intervals would be shuffled whole for that.
    """
    per_key = dim.dropna(subset=on).groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.max("n")).first()[0] or 0


def _range_join(
    fact: DataFrame, versions: DataFrame, on: list[str], date_col: str, sk: str
) -> DataFrame:
    matches = [F.col(f"f.{k}") == F.col(f"v.{k}") for k in on]
    valid = (F.col(f"f.{date_col}") >= F.col("v._from")) & (
        F.col(f"f.{date_col}") < F.col("v._until")
    )
    return (
        fact.alias("f")
        .join(versions.alias("v"), [*matches, valid], "left")
        .select("f.*", f"v.{sk}")
    )


def _asof_join(
    fact: DataFrame, versions: DataFrame, on: list[str], date_col: str, sk: str
) -> DataFrame:
    """Two bounded steps instead of facts times versions.

    The distinct (key, day) pairs collapse before they are shuffled, so the timeline of a key
    has at most one row per day for its facts and one per version, however hot the key is. The
    facts then meet at most one row per (key, day); a hot pair is left to AQE's skew split.

    The facts are read twice. Neither reading filters NULLs (they find no version anyway, and the
    last join is NULL-safe for that reason), so both can share the shuffles that produced them.
    """
    versions = versions.where(~any_null(on))
    asked = (
        fact.select(*on, F.col(date_col).cast("date").alias("_day"))
        .distinct()
        .withColumn("_asked", F.lit(1))
    )
    marks = versions.select(
        *on,
        F.col("_from").alias("_day"),
        F.lit(0).alias("_asked"),
        F.struct(F.col(sk).alias("sk"), F.col("_until").alias("until")).alias("_version"),
    )
    timeline = asked.unionByName(marks, allowMissingColumns=True)
    so_far = (
        Window.partitionBy(*on)
        .orderBy("_day", "_asked")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    resolved = (
        timeline.withColumn("_version", F.last("_version", ignorenulls=True).over(so_far))
        .where((F.col("_asked") == 1) & (F.col("_day") < F.col("_version.until")))
        .select(*on, "_day", F.col("_version.sk").alias(sk))
    )
    matches = [F.col(f"f.{k}").eqNullSafe(F.col(f"r.{k}")) for k in on]
    same_day = F.col(f"f.{date_col}").cast("date").eqNullSafe(F.col("r._day"))
    return (
        fact.alias("f").join(resolved.alias("r"), [*matches, same_day], "left").select("f.*", f"r.{sk}")
    )


def changed_intervals(
    before: DataFrame,
    after: DataFrame,
    on: list[str],
    sk: str,
    closed: str = "left",
    start: str = START,
    end: str = END,
) -> DataFrame:
    """``(key, _from, _until, _lost)``: when a join to ``after`` may differ from one to ``before``.

    The symmetric difference of both sets of versions, day by day: the days on which only one of
    them gives the key this surrogate key, ``_until`` exclusive. A version that merely ends earlier
    than before gives the days after its new end; one that both sets have for the same days gives
    none, whatever its other columns hold. A fact outside of the intervals of its key resolves as
    before. ``_lost`` tells whether the key lost any day: if not, only facts without a version change.

    The ends of all versions are counted with a sign, and what both sets have cancels out before
    anything is sorted. Versions with a NULL in the key are left out, since no fact meets them.
    """
    sides = [
        _half_open(dim, on, sk, closed, start, end).where(~any_null(on)).withColumn("_side", F.lit(side))
        for dim, side in ((before, -1), (after, 1))
    ]
    ends = F.array(
        F.struct(F.col("_from").alias("_day"), F.col("_side")),
        F.struct(F.col("_until").alias("_day"), (-F.col("_side")).alias("_side")),
    )
    steps = (
        sides[0].unionByName(sides[1]).select(*on, sk, F.inline(ends))
        .groupBy(*on, sk, "_day").agg(F.sum("_side").alias("_step")).where("_step <> 0")
    )
    so_far = Window.partitionBy(*on, sk).orderBy("_day")
    return (
        steps.withColumns({"_apart": F.sum("_step").over(so_far), "_until": F.lead("_day").over(so_far)})
        .where("_apart <> 0")
        .withColumn("_lost", F.min("_apart").over(Window.partitionBy(*on)) < 0)
        .select(*on, F.col("_day").alias("_from"), "_until", "_lost").distinct()
    )


def touched_days(fact: DataFrame, intervals: DataFrame, on: list[str], date_col: str) -> DataFrame:
    """The distinct days on which facts lie within an interval of their key.

    Facts are cut to distinct (key, day) pairs first, so that a hot key has one row a day.
    """
    asked = fact.select(*on, F.col(date_col).cast("date").alias("_day")).distinct()
    matches = [F.col(f"a.{k}") == F.col(f"i.{k}") for k in on]
    valid = (F.col("a._day") >= F.col("i._from")) & (F.col("a._day") < F.col("i._until"))
    return asked.alias("a").join(intervals.alias("i"), [*matches, valid], "left_semi").select("_day").distinct()


def lookup(fact: DataFrame, dim: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Current-value left join to a dimension that is unique on ``on``."""
    return fact.join(dim.select(*on, *columns), on, "left").select(*fact.columns, *columns)


def inherit_keys(
    child: DataFrame,
    parent: DataFrame,
    on: list[str],
    columns: list[str],
    parent_unique: bool = False,
) -> DataFrame:
    """Left join that takes over resolved keys from another fact, keeping the child's grain.

    The parent is reduced before the join to the row with the smallest ``columns`` per key, so a
    parent key with several rows never multiplies children, and a hot one arrives pre-aggregated.
    Join and reduction share one shuffle of the parent. Rows with a NULL in ``on`` match nothing
    and are left out before it. ``parent_unique=True`` is the caller's promise that ``on``
    identifies one parent row, and skips the reduction.
    """
    keys = parent.select(*on, *columns).dropna(subset=on)
    if not parent_unique:
        keys = (
            keys.groupBy(*on)
            .agg(F.min(F.struct(*columns)).alias("_first"))
            .select(*on, *[F.col(f"_first.{c}").alias(c) for c in columns])
        )
    return child.join(keys, on, "left").select(*child.columns, *columns)


def fk_audit(fact: DataFrame, fact_name: str, references: dict[str, DataFrame]) -> DataFrame:
    """Per foreign key: fact rows, rows without a key, and rows whose key is in no dimension.

    ``references`` maps a fact column to the dimension that has a column of the same name. The
    fact is read once for all keys and counted per key before the join, which so sees each key
    once however many rows hold it.
    """
    kinds = {fact.schema[c].dataType.simpleString() for c in references}
    kind = kinds.pop() if len(kinds) == 1 else "string"

    def entry(column: str) -> Column:
        return F.struct(F.lit(column).alias("key_column"), F.col(column).cast(kind).alias("key"))

    per_key = (
        fact.select(F.inline(F.array(*[entry(c) for c in references])))
        .groupBy("key_column", "key")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    known = reduce(
        DataFrame.unionByName, [dim.select(entry(c).alias("e")) for c, dim in references.items()]
    )
    known = known.select("e.*").distinct().withColumn("_known", F.lit(True))
    missing, orphan = F.col("key").isNull(), F.col("_known").isNull()
    counted = (
        per_key.join(known, ["key_column", "key"], "left")
        .groupBy("key_column")
        .agg(
            F.sum("n").alias("fact_rows"),
            F.sum(F.when(missing, F.col("n"))).alias("unresolved_rows"),
            F.sum(F.when(~missing & orphan, F.col("n"))).alias("orphan_rows"),
        )
    )
    names = fact.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(c) for c in references])).alias("key_column")
    )
    totals = ("fact_rows", "unresolved_rows", "orphan_rows")
    return names.join(counted, "key_column", "left").select(
        F.lit(fact_name).alias("fact_name"),
        "key_column",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in totals],
    )


def live_interval(
    fact: DataFrame,
    intervals: DataFrame,
    on: list[str],
    date_col: str,
    start: str,
    end: str,
    best: list[Column],
    values: list[str],
) -> DataFrame:
    """Add the best of the intervals (both ends included) that cover a fact's key and day.

    Intervals of a key may overlap, in any number. They are cut at month borders and met with
    the facts' distinct (key, day) pairs by key and month, so only what shares a month is
    compared; the best one, by the sort columns ``best``, is picked per pair before the facts are
    joined. Every fact row stays once, with NULLs where no interval covers it.
    """
    asked = fact.select(*on, F.col(date_col).cast("date").alias("_day")).distinct()
    first, last = asked.agg(F.min("_day"), F.max("_day")).first()
    if first is None:
        first = last = OPEN_END
    # Only months that occur among the facts matter, which also bounds open intervals.
    begins = F.greatest(F.trunc(start, "month"), F.trunc(F.lit(first), "month"))
    until = F.least(open_end(F.col(end)), F.lit(last))
    months = (
        intervals.where((F.col(start) <= F.lit(last)) & (open_end(F.col(end)) >= F.lit(first)))
        .where(F.col(start) <= open_end(F.col(end)))
        .withColumn("_month", F.explode(F.sequence(begins, until, F.expr("INTERVAL 1 MONTH"))))
    )
    matches = [F.col(f"a.{k}") == F.col(f"i.{k}") for k in on]
    covered = (
        asked.withColumn("_month", F.trunc("_day", "month"))
        .alias("a")
        .join(
            months.alias("i"),
            [
                *matches,
                F.col("a._month") == F.col("i._month"),
                F.col("a._day") >= F.col(f"i.{start}"),
                F.col("a._day") <= open_end(F.col(f"i.{end}")),
            ],
        )
        .select(*[f"a.{k}" for k in on], "a._day", *[f"i.{v}" for v in values])
    )
    chosen = dedup_latest(covered, [*on, "_day"], best, tie_break=values)
    matches = [F.col(f"f.{k}") == F.col(f"c.{k}") for k in on]
    same_day = F.col(f"f.{date_col}").cast("date") == F.col("c._day")
    return (
        fact.alias("f")
        .join(chosen.alias("c"), [*matches, same_day], "left")
        .select("f.*", *[f"c.{v}" for v in values])
    )
