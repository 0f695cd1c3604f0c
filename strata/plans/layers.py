"""Runs of the layers: landing files -> bronze -> silver -> gold."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from strata.functions import rules as R
from strata.functions.columns import OPEN_END
from strata.operators.dedup import dedup_latest, dedup_mostly_unique
from strata.operators.incremental import read_incremental
from strata.operators.joins import changed_intervals, touched_days
from strata.operators.layout import cluster
from strata.operators.merge import merge_upsert
from strata.operators.quality import FAILED, HEALTHY_PASS_RATE, Gate, rule_counts, validate
from strata.operators.scd2 import (
    CURRENT,
    START,
    scd2_change,
    scd2_initial,
    scd2_rebuild,
    scd2_splice,
)
from strata.plans import star
from strata.sources.landing import (
    BATCH_ID,
    CORRUPT,
    INGEST_DATE,
    INGEST_TS,
    SOURCE_FILE,
    list_files,
    read_landing,
    tag_metadata,
)
from strata.session import materialize, shuffles_freed, side_by_side, temporary_steps
from strata.sources.tables import (
    DIRECTORY,
    Tables,
    Written,
    generation_of,
    touched_directories,
)
from strata.spec import TableSpec

OK = "_dq_ok"

#: Files of the landing ledger: the rows of an active file are in bronze, those of a superseded one
#: were replaced by another delivery and are never read again.
STATE, ACTIVE, SUPERSEDED = "state", "active", "superseded"


def with_period(df: DataFrame, day: str, period: str) -> DataFrame:
    """Add the first day of each row's period, e.g. ``_month``, as a partition column."""
    return df if period == "day" else df.withColumn(f"_{period}", F.trunc(day, period))


def layout_of(columns: Iterable[str], period: str) -> list[str]:
    """Partition columns: the period's, if there is one, instead of the date column."""
    columns = list(columns)
    return columns if period == "day" or not columns else [f"_{period}"]


# -- bronze -----------------------------------------------------------------------------


def _bronze_checks(spec: TableSpec, as_of: dt.date) -> list[R.Rule]:
    return [
        R.well_formed(CORRUPT),
        *R.build_all(spec.dq_rules, as_of),
        R.key_present(spec.business_key),
    ]


def store_bronze(
    tables: Tables,
    spec: TableSpec,
    tagged: DataFrame,
    as_of: dt.date,
    consumed: Iterable[str] = (),
    gate: Gate | None = None,
) -> dict[str, object]:
    """Validate a tagged batch and append it to bronze and quarantine in one pass.

    The landing files are parsed once: both sides and all counts come from the same write.
    ``consumed`` marks the batch in the bronze ledger, in the same publication.

    With a ``gate`` the batch is written, audited by what was counted on the way, and only then
    published; a batch with faults is held whole and named in the result's ``skipped``, until
    ``release_held`` or ``discard_held``.
    """
    checks, declared = _bronze_checks(spec, as_of), spec.schema.names
    flagged = validate(tagged, checks).flagged.withColumn(OK, F.size(FAILED) == 0)
    written = tables.write_split(
        flagged,
        OK,
        accepted=("bronze", spec.name),
        rejected=("quarantine", spec.name),
        partition_by=[INGEST_DATE],
        metrics=[*rule_counts(checks), *(gate.metrics(declared, CORRUPT) if gate else [])],
        drop_accepted=[FAILED, CORRUPT],
        consumed=consumed,
        accept=(lambda observed: not gate.faults(observed, declared)) if gate else None,
        held=("held", spec.name),
    )
    counts = _counts(spec.name, "bronze", checks, written.metrics)
    if not written.published:
        counts["generation"] = written.generation
        counts["skipped"] = "; ".join(gate.faults(written.metrics, declared))
    return counts


def held_batches(tables: Tables, spec: TableSpec) -> list[str]:
    """Generations that a gate holds back."""
    return tables.generations("held", spec.name)


def release_held(tables: Tables, spec: TableSpec, generation: str) -> None:
    """Publish a held batch after all: good rows to bronze, rejects to quarantine."""
    tables.publish_held(
        ("held", spec.name), generation, OK, ("bronze", spec.name), ("quarantine", spec.name), [FAILED, CORRUPT]
    )


def discard_held(tables: Tables, spec: TableSpec, generation: str) -> None:
    """Forget a held batch; its files are not read again, corrected ones are new files."""
    tables.drop_directories("held", spec.name, lambda d: generation_of(d) == generation)


def replay_quarantine(tables: Tables, spec: TableSpec, as_of: dt.date) -> dict[str, object]:
    """Bring rejected rows that pass the rules as they are now into bronze, each exactly once.

    Rows keep their ingest day, so that silver does not take them for newer than what came after.
    The others stay in quarantine with the rules they fail now. Bronze is marked with the
    publication of the quarantine table whose rows it took: if the run stops before quarantine is
    published without them, the next one does only that. Without a row that passes, nothing is
    written.
    """
    checks, state = _bronze_checks(spec, as_of), tables.published("quarantine", spec.name)
    if state is None:
        return _counts(spec.name, "bronze", checks, {})
    rows = tables.read("quarantine", spec.name).drop(FAILED)
    flagged = validate(rows, checks).flagged.withColumn(OK, F.size(FAILED) == 0)
    mark = f"replay-{state.version}"
    bronze = tables.published("bronze", spec.name)
    taken = bronze is not None and mark in bronze.consumed
    if taken:
        flagged = flagged.where(~F.col(OK))
    elif flagged.where(OK).isEmpty():
        return _counts(spec.name, "bronze", checks, flagged.agg(*rule_counts(checks)).first().asDict())
    written = tables.write_split(
        flagged.select(*state.schema.names, OK),
        OK,
        accepted=("bronze", spec.name),
        rejected=("quarantine", spec.name),
        partition_by=[INGEST_DATE],
        metrics=rule_counts(checks),
        drop_accepted=[FAILED, CORRUPT],
        consumed=[mark],
        replace_rejected=True,
    )
    return _counts(spec.name, "bronze", checks, written.metrics)


def ingest_bronze(
    tables: Tables,
    spec: TableSpec,
    landing: str | list[str],
    as_of: dt.date,
    batch_id: str | None = None,
    on_bad: str = "quarantine",
    only_new_files: bool = True,
    ingest_ts: dt.datetime | None = None,
    paths_only: DataFrame | None = None,
    gate: Gate | None = None,
) -> dict[str, object]:
    """Read the landing files of a table into bronze.

    With a ``gate`` the files of the run are published or held as one batch, see ``store_bronze``.

    Rows carry ``ingest_ts``, by default a moment after that of every batch stored before, so that
    the later of two runs is the newer one. ``paths_only`` restricts the run to some files.

    Files already read, by path and modification time, are skipped, whether their rows are still in
    bronze or another delivery superseded them; ``only_new_files=False`` reads the whole folder again. The file list is recorded after the data: should a run stop in
    between, the files are read twice and the duplicates fall to the next layer's deduplication.
    """
    with temporary_steps(tables.spark):
        files = list_files(tables.spark, landing)
        ledger = f"{spec.name}_files"
        if only_new_files and tables.exists("bronze", ledger):
            seen = tables.read("bronze", ledger)
            files = files.join(seen, [SOURCE_FILE, "modified"], "left_anti")
        if paths_only is not None:
            files = files.join(paths_only.select(SOURCE_FILE).distinct(), SOURCE_FILE, "left_semi")
        files = materialize(files)
        # A scan needs the path of every file on the driver in any case.
        paths = [row[0] for row in files.select(SOURCE_FILE).collect()]
        if not paths:
            return _counts(spec.name, "bronze", [], {})
        raw = read_landing(tables.spark, paths, spec.schema, on_bad)
        if on_bad == "fail":
            raw = raw.withColumn(CORRUPT, F.lit(None).cast("string"))
        moment = ingest_ts or next_ingest_ts(tables, spec, as_of)
        tagged = tag_metadata(raw, batch_id or str(uuid.uuid4()), moment, ingest_date=as_of)
        result = store_bronze(tables, spec, tagged, as_of, gate=gate)
        tables.append(
            files.withColumn(STATE, F.lit(ACTIVE)).withColumn(INGEST_DATE, F.lit(as_of)),
            "bronze",
            ledger,
            partition_by=[INGEST_DATE],
        )
        return result


def next_ingest_ts(tables: Tables, spec: TableSpec, as_of: dt.date) -> dt.datetime:
    """Midnight of ``as_of``, or a microsecond after the newest stored batch if that is later.

    Batches only ever get later, so the newest generation holds the greatest moment.
    """
    moment = dt.datetime.combine(as_of, dt.time(tzinfo=dt.timezone.utc))
    generations = tables.generations("bronze", spec.name)
    if not generations:
        return moment
    newest = max(generations, key=lambda g: int(g.split("=")[1]))
    rows = tables.read("bronze", spec.name, only=lambda d: generation_of(d) == newest)
    stored = rows.agg(F.max(INGEST_TS)).first()[0]
    if stored is None:
        return moment
    return max(moment, dt.datetime.fromisoformat(stored) + dt.timedelta(microseconds=1))


def run_bronze(
    tables: Tables,
    specs: Iterable[TableSpec],
    landing_root: str,
    as_of: dt.date,
    at_once: int = 1,
    **options,
) -> dict[str, dict]:
    """All tables, in order or several at once; the first failure stops the run."""

    def ingest(spec: TableSpec) -> dict:
        landing = f"{landing_root}/{spec.source_path or spec.name}"
        return ingest_bronze(tables, spec, landing, as_of, **options)

    return _each(tables, specs, ingest, at_once)


def _each(
    tables: Tables, specs: Iterable[TableSpec], step: Callable[[TableSpec], dict], at_once: int
) -> dict[str, dict]:
    specs = list(specs)
    with shuffles_freed(tables.spark):
        results = side_by_side(tables.spark, [partial(step, spec) for spec in specs], at_once)
    return {spec.name: result for spec, result in zip(specs, results)}


# -- silver -----------------------------------------------------------------------------


@dataclass(frozen=True)
class _Batch:
    """Unprocessed bronze rows, deduplicated and flagged, and how many there were before."""

    flagged: DataFrame
    checks: list[R.Rule]
    pending: list[str]
    rows: int


def pending_generations(tables: Tables, spec: TableSpec) -> dict[str, list[str]]:
    """Bronze generations that silver has not seen, by ingest day, oldest day first."""
    state = tables.published("silver", spec.name)
    done = set(state.consumed) if state else set()
    bronze = tables.published("bronze", spec.name)
    days: dict[str, list[str]] = {}
    for directory in bronze.dirs if bronze else ():
        generation = generation_of(directory)
        if generation in done:
            continue
        marks = [p.split("=", 1)[1] for p in directory.split("/") if p.startswith(f"{INGEST_DATE}=")]
        own = days.setdefault(marks[0] if marks else "", [])
        if generation not in own:
            own.append(generation)
    return dict(sorted(days.items()))


def _newest_seen(tables: Tables, spec: TableSpec) -> str:
    """The latest ingest day of the bronze generations that silver has seen, or an empty text."""
    state, bronze = tables.published("silver", spec.name), tables.published("bronze", spec.name)
    done = set(state.consumed) if state else set()
    seen = [d for d in bronze.dirs if generation_of(d) in done] if bronze else []
    mark = f"{INGEST_DATE}="
    return max((p.removeprefix(mark) for d in seen for p in d.split("/") if p.startswith(mark)), default="")


def _batch(
    tables: Tables,
    spec: TableSpec,
    as_of: dt.date,
    mode: str,
    pending: list[str] | None = None,
) -> _Batch | None:
    state = tables.published("silver", spec.name)
    if pending is None:
        pending = [g for own in pending_generations(tables, spec).values() for g in own]
    if mode == "batch":
        incremental = tables.read("bronze", spec.name, only=lambda d: generation_of(d) in pending)
        if not pending:
            return None
    elif mode == "date":
        incremental = read_incremental(
            tables.read("bronze", spec.name),
            tables.read("silver", spec.name) if state else None,
        )
    else:
        raise ValueError("mode must be 'batch' or 'date'")
    key = list(spec.business_key)
    values = [c["name"] for c in spec.columns if c["name"] not in key]
    deduped, rows = dedup_mostly_unique(
        incremental, key, [INGEST_DATE, INGEST_TS], tie_break=[*values, SOURCE_FILE, BATCH_ID]
    )
    checks = [*R.build_all(spec.dq_rules, as_of), R.key_present(key)]
    flagged = validate(deduped, checks).flagged.withColumn(OK, F.size(FAILED) == 0)
    return _Batch(flagged, checks, pending, rows)


def _stage(tables: Tables, spec: TableSpec, batch: _Batch) -> tuple[DataFrame, dict]:
    """The good rows of the batch from a staging table; the others go to quarantine.

    A merge reads its batch several times. A written table survives lost executors and gives
    those steps pruned columns and exact sizes to plan with.
    """
    written = tables.write(
        batch.flagged, "stage", spec.name, partition_by=[OK], metrics=rule_counts(batch.checks)
    )
    tables.prune("stage", spec.name)
    staged = tables.read("stage", spec.name)
    counts = _silver_counts(spec, batch, written.metrics)
    _quarantine(tables, spec, staged, counts)
    return _good(staged), counts


def _silver_counts(spec: TableSpec, batch: _Batch, metrics: dict) -> dict[str, object]:
    return {
        "incremental_count": batch.rows,
        **_counts(spec.name, "silver", batch.checks, metrics),
    }


def _good(flagged: DataFrame) -> DataFrame:
    return flagged.where(F.col(OK)).drop(OK, FAILED)


def _quarantine(tables: Tables, spec: TableSpec, flagged: DataFrame, counts: dict) -> None:
    if counts["invalid_count"]:
        rejects = flagged.where(~F.col(OK)).drop(OK)
        tables.append(rejects, "quarantine", f"{spec.name}_silver")


def _nothing_new(spec: TableSpec) -> dict:
    return {"incremental_count": 0, **_counts(spec.name, "silver", [], {})}


def refine_fact(
    tables: Tables,
    spec: TableSpec,
    as_of: dt.date,
    mode: str = "batch",
    newer_than: str | None = None,
) -> dict[str, object]:
    """Upsert the unprocessed bronze rows into silver.

    Only silver directories that hold a key of the batch are rewritten; the others stay in place
    and new keys go to new files. Rows of a late ingest day, before one that silver has seen, do not
    replace rows of a later day.
    """
    if spec.keeps_history:
        raise ValueError(f"{spec.name} keeps history; use refine_dimension")
    pending = pending_generations(tables, spec)
    if newer_than is None and pending and min(pending) < _newest_seen(tables, spec):
        newer_than = INGEST_DATE
    batch = _batch(tables, spec, as_of, mode)
    if batch is None:
        return _nothing_new(spec)
    key, layout = list(spec.business_key), _layout(spec)
    if not tables.exists("silver", spec.name):
        return _first_load(tables, spec, batch)
    valid, counts = _stage(tables, spec, batch)
    if not counts["incremental_count"]:
        return _nothing_new(spec)
    valid = _placed(valid, spec)
    rows = tables.read("silver", spec.name, with_directory=True)
    touched = touched_directories(rows, valid, key, layout)
    if touched:
        affected = tables.read("silver", spec.name, only=lambda d: d in touched)
        valid = merge_upsert(valid, affected, key, newer_than, check_unique=False)
    tables.write(
        _sized(valid, layout),
        "silver",
        spec.name,
        keep=lambda d: d not in touched,
        partition_by=layout,
        consumed=batch.pending,
    )
    return counts


def _layout(spec: TableSpec) -> list[str]:
    return layout_of(spec.partition_by, spec.partition_period)


def _placed(df: DataFrame, spec: TableSpec) -> DataFrame:
    return with_period(df, spec.partition_by[0], spec.partition_period) if spec.partition_by else df


def _first_load(tables: Tables, spec: TableSpec, batch: _Batch) -> dict[str, object]:
    """Write the good rows straight to silver, counting on the way.

    Rows already passed the rules in bronze, so rejects are the exception: only if there are any
    is the batch read again for them.
    """
    checked = Observation()
    counted = batch.flagged.observe(checked, *rule_counts(batch.checks))
    layout = _layout(spec)
    tables.write(
        _sized(_placed(_good(counted), spec), layout),
        "silver",
        spec.name,
        partition_by=layout,
        consumed=batch.pending,
    )
    counts = _silver_counts(spec, batch, checked.get)
    _quarantine(tables, spec, batch.flagged, counts)
    return counts


def refine_dimension(
    tables: Tables,
    spec: TableSpec,
    as_of: dt.date,
    mode: str = "batch",
    initial_start: dt.date | None = None,
) -> dict[str, object]:
    """Merge the unprocessed bronze rows into a type-2 history.

    History is partitioned by ``is_current``: a batch rewrites the current versions, adds the
    ones it closes and leaves those closed before untouched, all in one publication. Of those,
    only the column of surrogate keys is read.

    Several pending ingest days are merged one after the other, as of their own days (the last one
    as of ``as_of``), so that catching up gives the history that daily runs would have. A batch dated
    before versions that are already there is put into its place, see ``_splice``. Surrogate keys
    are never given twice, not even after the version that had one is gone.
    """
    if not spec.keeps_history:
        raise ValueError(f"{spec.name} keeps no history; use refine_fact")
    days = list(pending_generations(tables, spec).items()) if mode == "batch" else []
    seen = _newest_seen(tables, spec)
    if len(days) > 1 or (days and days[0][0] < seen):
        steps = []
        for day, own in days:
            own_day = day and (day != days[-1][0] or day < seen)
            moment = dt.date.fromisoformat(day) if own_day else as_of
            steps.append(_refine_dimension(tables, spec, moment, mode, initial_start, own))
            initial_start = None
        return _added(steps)
    return _refine_dimension(tables, spec, as_of, mode, initial_start)


def _added(steps: list[dict]) -> dict[str, object]:
    """The counts of several steps as those of one."""
    total = {**steps[-1], "violations": {}}
    for count in ("incremental_count", "total_count", "valid_count", "invalid_count"):
        total[count] = sum(step[count] for step in steps)
    for step in steps:
        for label, n in step["violations"].items():
            total["violations"][label] = total["violations"].get(label, 0) + n
    total["pass_rate"] = total["valid_count"] * 100.0 / total["total_count"] if total["total_count"] else 100.0
    total["level"] = "INFO" if total["pass_rate"] >= HEALTHY_PASS_RATE else "WARNING"
    return total


def _refine_dimension(
    tables: Tables,
    spec: TableSpec,
    as_of: dt.date,
    mode: str,
    initial_start: dt.date | None,
    pending: list[str] | None = None,
) -> dict[str, object]:
    batch = _batch(tables, spec, as_of, mode, pending)
    if batch is None:
        return _nothing_new(spec)
    valid, counts = _stage(tables, spec, batch)
    if not counts["incremental_count"]:
        return _nothing_new(spec)
    key, tracked, sk = list(spec.business_key), list(spec.tracked_columns), spec.surrogate_key_col
    options = {"partition_by": [CURRENT], "consumed": batch.pending, "numbered": sk}
    with temporary_steps(tables.spark):
        if not tables.exists("silver", spec.name):
            opened = scd2_initial(valid, key, tracked, sk, as_of, initial_start)
            tables.write(opened, "silver", spec.name, **options)
            return counts
        is_current = f"{CURRENT}=true"
        current = tables.read("silver", spec.name, only=lambda d: is_current in d.split("/"))
        following = tables.next_number("silver", spec.name, sk)
        newest = current.agg(F.max(START)).first()[0]
        if newest is not None and newest > as_of:
            _splice(tables, spec, valid, as_of, following, batch, options)
            return counts
        change = scd2_change(valid, current, key, tracked, sk, as_of, following)
        if change is None:
            tables.mark_consumed("silver", spec.name, batch.pending)
            return counts
        tables.write(
            change.kept.unionByName(change.closed).unionByName(change.opened),
            "silver",
            spec.name,
            keep=lambda d: is_current not in d.split("/"),
            **options,
        )
        return counts


def _splice(
    tables: Tables,
    spec: TableSpec,
    late: DataFrame,
    as_of: dt.date,
    following: int,
    batch: _Batch,
    options: dict,
) -> None:
    """Put a late batch into the histories of its keys; only directories that hold one are rewritten.

    A history does not show on which later days a key was reported unchanged. The next such day, on
    which an old value comes back, is taken from the bronze generations that silver has seen.
    """
    key = list(spec.business_key)
    rows = tables.read("silver", spec.name, with_directory=True)
    touched = touched_directories(rows, late, key)
    affected = tables.read("silver", spec.name, only=lambda d: d in touched)
    own, others = (affected.join(late.select(*key), key, how) for how in ("left_semi", "left_anti"))
    seen = set(tables.published("silver", spec.name).consumed)
    reported = tables.read("bronze", spec.name, only=lambda d: generation_of(d) in seen)
    reported = validate(reported.where(F.col(INGEST_DATE) > F.lit(as_of)), batch.checks).valid
    spliced = scd2_splice(
        late, own, reported.select(*key, INGEST_DATE), INGEST_DATE, key, list(spec.tracked_columns),
        spec.surrogate_key_col, as_of, following,
    )
    tables.write(
        others.select(*rows.drop(DIRECTORY).columns).unionByName(spliced.select(*rows.drop(DIRECTORY).columns)),
        "silver",
        spec.name,
        keep=lambda d: d not in touched,
        **options,
    )


def run_silver(
    tables: Tables,
    specs: Iterable[TableSpec],
    as_of: dt.date,
    mode: str = "batch",
    initial_start: dt.date | None = None,
    at_once: int = 1,
) -> dict[str, dict]:
    """All tables, as history or as upsert; the first failure stops the run."""

    def refine(spec: TableSpec) -> dict:
        if spec.keeps_history:
            return refine_dimension(tables, spec, as_of, mode, initial_start)
        return refine_fact(tables, spec, as_of, mode)

    return _each(tables, specs, refine, at_once)


# -- gold -------------------------------------------------------------------------------

#: Gold table -> the published tables it is built from, in build order.
GOLD_INPUTS: dict[str, tuple[tuple[str, str], ...]] = {
    "dim_customer": (("silver", "customer"),),
    "dim_product": (("silver", "product"),),
    "dim_store": (("silver", "store"),),
    "dim_supplier": (("silver", "supplier"),),
    "dim_date": (),
    "fact_sales": (
        ("silver", "sales"), ("gold", "dim_customer"), ("gold", "dim_product"), ("gold", "dim_store"),
    ),
    "fact_returns": (("silver", "returns"), ("gold", "fact_sales")),
    "fact_online_orders": (
        ("silver", "online_orders"), ("gold", "dim_customer"), ("gold", "dim_product"),
    ),
    "fact_shipping": (("silver", "shipping"), ("gold", "fact_online_orders")),
    "fact_inventory_snapshot": (
        ("silver", "inventory"), ("gold", "dim_product"), ("gold", "dim_store"),
    ),
    "bridge_promotions": (("silver", "promotions"), ("gold", "dim_product")),
}

#: Gold tables that are partitioned by their event date.
GOLD_PARTITIONS = {
    "fact_sales": ["sale_date"],
    "fact_online_orders": ["order_date"],
    "fact_inventory_snapshot": ["snapshot_date"],
}

#: Gold tables whose files are clustered on several keys.
GOLD_CLUSTERS = {"fact_sales": ["customer_sk", "product_sk"]}


#: Gold dimensions that show a silver history as it is.
GOLD_SHOWN = ("dim_customer", "dim_product")

#: Gold dimensions whose surrogate keys, named here, survive a rebuild.
GOLD_NUMBERED = {"dim_store": "store_sk", "dim_supplier": "supplier_sk"}

#: Business key and surrogate key of each dimension that facts refer to, and whether a fact meets
#: the version of its own day.
GOLD_KEYS = {
    "dim_customer": ("customer_id", "customer_sk", True),
    "dim_product": ("stock_code", "product_sk", True),
    "dim_store": ("store_id", "store_sk", False),
}


def build_gold(
    tables: Tables,
    name: str,
    partitions: dict[str, list[str]] = GOLD_PARTITIONS,
    incremental: bool = False,
    calendar: tuple[dt.date, dt.date] | None = None,
    period: str = "day",
) -> dict[str, object]:
    """Build and publish one gold table; without its inputs it is skipped with zero rows.

    ``calendar`` is the first and last day of ``dim_date``; by default the whole years of the facts.

    ``partitions`` may name another layout, e.g. none for facts with few rows per day, and ``period``
    may be ``"month"`` or ``"year"`` to put a period instead of a day into a directory. With
    ``incremental`` a fact partitioned by its date rebuilds only the directories that can have
    changed, see ``stale_directories``; the result is the same.
    """
    missing = [f"{layer}.{t}" for layer, t in GOLD_INPUTS[name] if not tables.exists(layer, t)]
    if missing:
        return _built(name, 0, f"not built yet: {', '.join(missing)}")
    if name in GOLD_SHOWN:
        tables.publish_as(GOLD_INPUTS[name][0], "gold", name)
        return _built(name, tables.read("gold", name).count())
    days = partitions.get(name, [])
    layout = layout_of(days, period)
    keep = None
    with temporary_steps(tables.spark):
        stale = stale_directories(tables, name, days, period) if incremental else None
        inputs = [tables.read(layer, table) for layer, table in GOLD_INPUTS[name]]
        if stale is not None:
            facts = GOLD_INPUTS[name][0]
            if not any(stale(d) for d in _day_directories(tables, name)):
                tables.note_inputs("gold", name, _input_marks(tables, name))
                return _built(name, tables.read("gold", name).count(), "unchanged")
            inputs[0] = tables.read(*facts, only=stale)
            keep = lambda d: not stale(d)
        numbered = GOLD_NUMBERED.get(name)
        if name == "dim_date":
            built = star.dim_date(tables.spark, *(calendar or calendar_range(tables)))
        elif numbered and tables.exists("gold", name):
            first = tables.next_number("gold", name, numbered)
            built = getattr(star, name)(*inputs, tables.read("gold", name), first)
        else:
            built = getattr(star, name)(*inputs)
        if days:
            built = with_period(built, days[0], period)
        options = {
            "keep": keep,
            "partition_by": layout,
            "metrics": [F.count(F.lit(1)).alias("row_count")],
            "inputs": _input_marks(tables, name),
            "numbered": numbered,
        }
        if name in GOLD_CLUSTERS:
            written = write_clustered(tables, built, "gold", name, GOLD_CLUSTERS[name], **options)
        else:
            written = tables.write(_sized(built, layout), "gold", name, **options)
    if len(layout) == 1:
        _note_unresolved(tables, name, layout, written.generation)
    if stale is not None:  # the write counted the rebuilt directories only
        return _built(name, tables.read("gold", name).count())
    return _built(name, written.metrics["row_count"])


#: Silver facts and their event dates, which the calendar has to cover.
EVENT_DATES = {
    "sales": "sale_date", "online_orders": "order_date", "inventory": "snapshot_date",
    "shipping": "ship_date",
}


def calendar_range(tables: Tables) -> tuple[dt.date, dt.date]:
    """From the first day of the facts' first year to the last day of their last year."""
    found = []
    for table, day in EVENT_DATES.items():
        if tables.exists("silver", table):
            rows = tables.read("silver", table)
            if day in rows.columns:
                found += [d for d in rows.agg(F.min(day), F.max(day)).first() if d is not None]
    years = [d.year for d in found] or [2026]
    return dt.date(min(years), 1, 1), dt.date(max(years), 12, 31)


def _built(name: str, rows: int, skipped: str | None = None) -> dict[str, object]:
    return {"table_name": name, "layer": "gold", "row_count": rows, "skipped": skipped}


def _input_marks(tables: Tables, name: str) -> dict[str, int]:
    """The version of each input."""
    return {f"{layer}.{t}": tables.published(layer, t).version for layer, t in GOLD_INPUTS[name]}


def _day_directories(tables: Tables, name: str) -> set[str]:
    """Published directories of a fact and of the silver table it is built from."""
    shown = [tables.published("gold", name), tables.published(*GOLD_INPUTS[name][0])]
    return {d for state in shown for d in state.dirs}


def stale_directories(
    tables: Tables, name: str, days: list[str], period: str
) -> Callable[[str], bool] | None:
    """Which partition directories of a fact are stale; ``None`` if it has to be built in full.

    A directory is stale if the silver directories of its days are not those of the last build, or
    if it holds a fact whose key may resolve to another version than in that build. The latter
    comes from the difference of each dimension's versions then and now (``changed_intervals``):
    corrected, removed, renumbered, late and new versions are all the same to it. Only the facts of
    changed keys, in the days for which they changed, count. Where a key only gained days, as one
    does that arrives after its facts, only directories with unresolved facts are looked through.
    """
    state, layout = tables.published("gold", name), tuple(layout_of(days, period))
    if state is None or not state.inputs or state.partition_by != layout or len(layout) != 1:
        return None
    silver = GOLD_INPUTS[name][0]
    now = tables.published(*silver)
    before = tables.published(*silver, version=state.inputs.get(".".join(silver), 0))
    if before is None or now.partition_by != layout or before.partition_by != layout:
        return None
    changed = {_value(d) for d in set(before.dirs) ^ set(now.dirs)}
    for layer, table in GOLD_INPUTS[name][1:]:
        then, current = state.inputs[f"{layer}.{table}"], tables.published(layer, table).version
        if then == current:
            continue
        if table not in GOLD_KEYS or not tables.readable(layer, table, then):
            return None
        intervals = materialize(_changed(tables, layer, table, then))
        key, sk, by_day = GOLD_KEYS[table]
        gaps = _unresolved(tables, name, sk)
        found = touched_days(_dated(tables.read(*silver), days[0]), intervals.where("_lost"), [key], "_event")
        unresolved = tables.read(*silver, only=lambda d: gaps is None or _value(d) in gaps)
        gained = touched_days(_dated(unresolved, days[0]), intervals.where("NOT _lost"), [key], "_event")
        found = found.union(gained)
        if not by_day:  # facts without a day have such a key, too
            found = found.withColumn("_day", F.when(F.col("_day") != F.expr(NO_DAY), F.col("_day")))
        # One row per directory at most.
        first = F.col("_day") if period == "day" else F.trunc("_day", period)
        changed |= {_directory_value(row[0]) for row in found.select(first).distinct().collect()}
    return lambda directory: _value(directory) in changed


def _note_unresolved(tables: Tables, name: str, layout: list[str], generation: str) -> None:
    """Count the facts without each key by directory, from the key columns of what was just written."""
    fresh = tables.read("gold", name, only=lambda d: generation_of(d) == generation)
    keys = [sk for _, sk, _ in GOLD_KEYS.values() if sk in fresh.columns]
    value = F.coalesce(F.col(layout[0]).cast("string"), F.lit(NO_PARTITION)).alias("value")
    counted = fresh.groupBy(value).agg(*[F.count_if(F.col(k).isNull()).alias(k) for k in keys])
    state, address = tables.published("gold", name), ("stage", f"{name}_unresolved")
    kept = [_value(d) for d in state.dirs if generation_of(d) != generation]
    if kept and tables.exists(*address):
        counted = counted.unionByName(tables.read(*address).where(F.col("value").isin(kept)))
    tables.write(counted, *address, inputs={f"gold.{name}": state.version})
    tables.prune(*address)


def _unresolved(tables: Tables, name: str, sk: str) -> set[str] | None:
    """Directories that hold facts without the key; ``None`` if that is not known."""
    noted = tables.published("stage", f"{name}_unresolved")
    if noted is None or noted.inputs != {f"gold.{name}": tables.published("gold", name).version}:
        return None
    rows = tables.read("stage", f"{name}_unresolved").where(F.col(sk) > 0).select("value")
    return {row[0] for row in rows.collect()}


#: Stands for the day of facts without one where they are to be found, too.
NO_DAY = "DATE'0001-01-01'"


def _dated(facts: DataFrame, day: str) -> DataFrame:
    return facts.withColumn("_event", F.coalesce(F.col(day).cast("date"), F.expr(NO_DAY)))


def _changed(tables: Tables, layer: str, table: str, then: int) -> DataFrame:
    """``changed_intervals`` of a dimension since a publication of it."""
    key, sk, by_day = GOLD_KEYS[table]
    sides = [tables.read(layer, table, version=then), tables.read(layer, table)]
    if not by_day:
        always = {"_start": F.expr(NO_DAY), "_end": F.lit(OPEN_END)}
        sides = [side.select(key, sk).withColumns(always) for side in sides]
        return changed_intervals(*sides, [key], sk, start="_start", end="_end")
    return changed_intervals(*sides, [key], sk)


def _value(directory: str) -> str:
    return directory.rsplit("/", 1)[-1].split("=", 1)[1]


def _directory_value(day: dt.date | None) -> str:
    return NO_PARTITION if day is None else day.isoformat()


#: Fixed value: what Spark names the directory of NULLs.
NO_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def waves(names: Iterable[str]) -> list[list[str]]:
    """Gold tables in groups that do not depend on each other, in an order in which they can be built."""
    names, depth = list(names), {}

    def of(name: str) -> int:
        if name not in depth:
            depth[name] = 1 + max((of(t) for layer, t in GOLD_INPUTS[name] if layer == "gold"), default=-1)
        return depth[name]

    return [[n for n in names if of(n) == level] for level in sorted({of(n) for n in names})]


def run_gold(
    tables: Tables,
    names: Iterable[str] = tuple(GOLD_INPUTS),
    partitions: dict[str, list[str]] = GOLD_PARTITIONS,
    incremental: bool = False,
    calendar: tuple[dt.date, dt.date] | None = None,
    period: str = "day",
    at_once: int = 1,
) -> dict[str, dict]:
    """All gold tables in dependency order; of those that do not depend on each other several at once."""
    names, results = list(names), {}
    for wave in waves(names):
        builds = [partial(build_gold, tables, n, partitions, incremental, calendar, period) for n in wave]
        with shuffles_freed(tables.spark):
            results.update(zip(wave, side_by_side(tables.spark, builds, at_once), strict=True))
    return {name: results[name] for name in names}


def write_clustered(
    tables: Tables,
    df: DataFrame,
    layer: str,
    table: str,
    columns: list[str],
    partition_by: Iterable[str] = (),
    partitions: int | None = None,
    scale: str = "linear",
    **options,
) -> Written:
    """Write a table with files clustered on ``columns`` inside its partitions.

    The frame is materialized and clustered from there: bounds, range sampling and the final
    write would each repeat the joins that produced it.
    """
    with temporary_steps(tables.spark):
        return tables.write(
            cluster(materialize(df), columns, list(partition_by), partitions, scale=scale),
            layer,
            table,
            partition_by=partition_by,
            **options,
        )


# -- reprocessing and metrics -----------------------------------------------------------


def reprocess(
    tables: Tables,
    specs: Iterable[TableSpec],
    landing_root: str,
    dates: Iterable[dt.date],
    as_of: dt.date | None = None,
    relanded: dict[dt.date, str] | None = None,
) -> list[dict]:
    """Read the files of past ingest days again and bring silver to what the corrected days give.

    Bronze and quarantine rows of the days are dropped and their own active files, no others, are
    read again, wherever they lie; ``relanded`` names another landing root for a day whose files were
    delivered anew, and supersedes those it had. Every business key that the days held before or hold now is then recomputed from all its
    bronze rows: facts keep the row of the latest day, histories are rebuilt day by day, and keys
    that are gone from bronze leave silver. Later days are thus never reverted. Versions whose key
    and start survive keep their surrogate key. Rules see ``as_of``, by default the last of the days.
    """
    days = sorted(set(dates))
    results = []
    for spec in specs:
        if not days or not tables.exists("bronze", spec.name):
            continue
        with temporary_steps(tables.spark), shuffles_freed(tables.spark):
            key = list(spec.business_key)
            held = tables.read("bronze", spec.name).where(F.col(INGEST_DATE).isin(days))
            before = materialize(held.select(*key).distinct())
            ledger = f"{spec.name}_files"
            files = tables.read("bronze", ledger)
            files = materialize(files.where(F.col(INGEST_DATE).isin(days)))
            for day in days:
                anew = (relanded or {}).get(day)
                tables.replace_partition(None, "bronze", spec.name, INGEST_DATE, day)
                if tables.exists("quarantine", spec.name):
                    tables.replace_partition(None, "quarantine", spec.name, INGEST_DATE, day)
                own = files.where(F.col(INGEST_DATE) == F.lit(day))
                retired = own if anew else own.where(F.col(STATE) == SUPERSEDED)
                tables.replace_partition(
                    retired.withColumn(STATE, F.lit(SUPERSEDED)), "bronze", ledger, INGEST_DATE, day
                )
                active = own.where(F.col(STATE) == ACTIVE)
                where = [f"{anew}/{spec.source_path or spec.name}"] if anew else _folders(tables, active)
                if where:
                    only = None if anew else active
                    results.append(
                        ingest_bronze(tables, spec, where, day, only_new_files=False, paths_only=only)
                    )
            held = tables.read("bronze", spec.name).where(F.col(INGEST_DATE).isin(days))
            touched = materialize(before.union(held.select(*key)).distinct().dropna(subset=key))
            results.append(_recompute(tables, spec, touched, as_of or days[-1]))
    return results


def _folders(tables: Tables, files: DataFrame) -> list[str]:
    """The folders of landing files that still exist; a scan needs their names on the driver."""
    folder = F.regexp_extract(SOURCE_FILE, "^(.*)/[^/]*$", 1)
    return [row[0] for row in files.select(folder).distinct().collect() if tables.there(row[0])]


def _recompute(tables: Tables, spec: TableSpec, touched: DataFrame, as_of: dt.date) -> dict:
    """Silver rows of the touched keys anew from all of bronze; all other rows stay.

    Bronze generations that silver has not seen are not marked as seen, except for those that hold
    nothing but touched keys' days: refining them later changes nothing that is already there.
    """
    key, layout = list(spec.business_key), _layout(spec)
    rows = tables.read("bronze", spec.name).join(touched, key, "left_semi")
    names = [c["name"] for c in spec.columns]
    values = [c for c in names if c not in key]
    checks = [*R.build_all(spec.dq_rules, as_of), R.key_present(key)]
    latest, ties = [INGEST_DATE, INGEST_TS], [*values, SOURCE_FILE, BATCH_ID]
    by = [*key, INGEST_DATE] if spec.keeps_history else key
    flagged = validate(dedup_latest(rows, by, latest, tie_break=ties), checks).flagged
    flagged = materialize(flagged.withColumn(OK, F.size(FAILED) == 0))
    counted = flagged.agg(
        F.count(F.lit(1)).alias("total_count"), F.count(F.when(F.col(OK), 1)).alias("valid_count")
    ).first()
    counts = {
        "incremental_count": counted["total_count"],
        **_counts(spec.name, "silver", [], counted.asDict()),
    }
    rejected = f"{spec.name}_silver"
    if tables.exists("quarantine", rejected):
        kept = tables.read("quarantine", rejected).join(touched, key, "left_anti")
        tables.write(materialize(kept), "quarantine", rejected)
    _quarantine(tables, spec, flagged, counts)
    good = _placed(_good(flagged), spec)
    seen = tables.generations("bronze", spec.name)
    if not tables.exists("silver", spec.name):
        step = refine_dimension if spec.keeps_history else refine_fact
        return step(tables, spec, as_of)
    silver = tables.read("silver", spec.name)
    untouched = silver.join(touched, key, "left_anti").select(*silver.columns)
    options = {"partition_by": [CURRENT] if spec.keeps_history else layout}
    if spec.keeps_history:
        following = tables.next_number("silver", spec.name, spec.surrogate_key_col)
        good = _rebuilt(spec, silver.join(touched, key, "left_semi"), silver, good, following)
    fresh = untouched.unionByName(good.select(*silver.columns))
    done = tables.published("silver", spec.name).consumed
    pending = {g for own in pending_generations(tables, spec).values() for g in own}
    mixed = _with_other_keys(tables, spec, pending, touched)
    whole = [g for g in seen if g not in done and g in pending and g not in mixed]
    if spec.keeps_history:
        options["numbered"] = spec.surrogate_key_col
    tables.write(_sized(fresh, options["partition_by"]), "silver", spec.name, consumed=whole, **options)
    return counts


def _with_other_keys(
    tables: Tables, spec: TableSpec, generations: set[str], touched: DataFrame
) -> set[str]:
    """Which of the generations hold rows of keys that are not touched."""
    rows = tables.read(
        "bronze", spec.name, only=lambda d: generation_of(d) in generations, with_directory=True
    )
    others = rows.join(touched, list(spec.business_key), "left_anti").select(DIRECTORY).distinct()
    return {generation_of(row[0]) for row in others.collect()}


def _rebuilt(
    spec: TableSpec, old: DataFrame, silver: DataFrame, good: DataFrame, following: int
) -> DataFrame:
    """The touched keys' history from their daily rows, surviving versions with their old key."""
    key, tracked, sk = list(spec.business_key), list(spec.tracked_columns), spec.surrogate_key_col
    first = silver.agg(F.min(START)).first()[0]
    began = good.agg(F.min(INGEST_DATE)).first()[0]
    # The first load may have dated its versions back; the same keys are dated back again.
    back = old.where(F.col(START) == F.lit(first)).select(*key).distinct() if first else None
    versions = scd2_rebuild(good, key, tracked, "_new_sk", INGEST_DATE, [INGEST_TS])
    if back is not None and began is not None and first < began:
        oldest = versions.groupBy(*key).agg(F.min(START).alias("_first"))
        dated = versions.join(oldest, key).join(back.withColumn("_back", F.lit(True)), key, "left")
        start = F.when(F.col("_back") & (F.col(START) == F.col("_first")), F.lit(first))
        versions = dated.withColumn(START, F.coalesce(start, F.col(START))).drop("_first", "_back")
    known = old.select(*key, START, F.col(sk).alias("_old_sk"))
    return (
        versions.join(known, [*key, START], "left")
        .withColumn(sk, F.coalesce("_old_sk", F.col("_new_sk") + F.lit(following)))
        .drop("_old_sk", "_new_sk")
    )


def run_metrics(tables: Tables, results: Iterable[dict]) -> DataFrame:
    """The results of a run as one row per step."""
    columns = {
        "table_name": "string", "layer": "string", "incremental_count": "bigint",
        "total_count": "bigint", "valid_count": "bigint", "invalid_count": "bigint",
        "row_count": "bigint", "pass_rate": "double", "level": "string", "skipped": "string",
    }
    rows = [tuple(result.get(c) for c in columns) for result in results]
    return tables.spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in columns.items()))


def _counts(table: str, layer: str, checks: list, metrics: dict) -> dict[str, object]:
    total, valid = metrics.get("total_count") or 0, metrics.get("valid_count") or 0
    rate = valid * 100.0 / total if total else 100.0
    return {
        "table_name": table,
        "layer": layer,
        "total_count": total,
        "valid_count": valid,
        "invalid_count": total - valid,
        "pass_rate": rate,
        "level": "INFO" if rate >= HEALTHY_PASS_RATE else "WARNING",
        "violations": {
            check.label: metrics[f"failed_{i}"]
            for i, check in enumerate(checks)
            if metrics.get(f"failed_{i}")
        },
    }


def _sized(df: DataFrame, partition_by: list[str]) -> DataFrame:
    """Bring rows of a partition value together before a partitioned write.

    A rebalance, unlike a repartition, lets AQE cut a value with much of the table into several
    files and merge small ones.
    """
    return df.hint("rebalance", *partition_by) if partition_by else df
