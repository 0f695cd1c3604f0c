"""What several operators share: Arrow-batched columns, label sampling, connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from strata.session import materialize

SLICE_BYTES = 8 << 20

#: The C library's function for it, where there is one.
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until the frame has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def give_back() -> None:
    """Return memory that this worker no longer uses to the machine.

    Python workers live on from one stage to the next, and what a stage has freed stays theirs.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    if TRIM is not None:
        TRIM(0)


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch so that a slice holds about ``limit`` bytes, one row at least."""
    rows = max(1, int(batch.num_rows * limit / max(1, batch.nbytes)))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def with_columns(
    df: DataFrame,
    inputs: Sequence[str],
    fields: Sequence[StructField],
    start: Callable[[], Callable[..., Sequence[pa.Array]]],
) -> DataFrame:
    """Append columns that Python computes from Arrow columns, a slice of a batch at a time.

    ``start()`` runs once per task and returns a function from the input arrays to the new arrays.
    A new column replaces one of the same name; all other columns stay as they are.
    """
    names = [f.name for f in fields]
    kept = [f for f in df.schema.fields if f.name not in names]
    kept_names, inputs = [f.name for f in kept], list(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        work = start()
        for batch in batches:
            for part in slices(batch):
                made = list(work(*[part.column(c) for c in inputs]))
                columns = [part.column(c) for c in kept_names] + made
                yield pa.RecordBatch.from_arrays(columns, names=kept_names + names)
        give_back()

    return df.mapInArrow(run, StructType([*kept, *fields]))


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The runs of equal (non-null, integer) keys of a sorted stream of batches, one at a time."""
    waiting: list[pa.RecordBatch] = []
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for column in columns:
            change[1:] |= column[1:] != column[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[start] for c in columns)
            if waiting and key != before:
                yield _whole(waiting)
                waiting = []
            before = key
            waiting.append(batch.slice(start, end - start))
    if waiting:
        yield _whole(waiting)


def _whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.concat_batches(parts)


def texts_of(array: pa.Array) -> list[str]:
    """Texts of an Arrow column, with an empty text for null."""
    return [value or "" for value in array.to_pylist()]


def fold(key: str | Column, folds: int) -> Column:
    """CRC-32 of the key as text, modulo ``folds``; a null key counts as the empty text."""
    text = (F.col(key) if isinstance(key, str) else key).cast("string")
    return F.crc32(F.coalesce(text, F.lit(""))) % folds


def labelled_sample(
    labels: DataFrame, label: str, train: Column, per_class: dict[int, int]
) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` labelled ids of each class, chosen by hash, and how many there are.

    The result has columns ``doc_id`` and ``label`` and no more rows than the given bounds add up
    to. Ids with both labels count as 1; rows without an id or a label are left out.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & train)
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("label"))
    )
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    parts = [
        known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
        for value, bound in per_class.items()
    ]
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.unionByName(part)
    return chosen, {value: sizes.get(value, 0) for value in per_class}


def union_find(a: Sequence[int], b: Sequence[int]) -> dict[int, int]:
    """The smallest member of each member's group."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a, b, strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


def _contracted(edges: DataFrame) -> DataFrame:
    """Each batch of edges as stars of its own groups: fewer rows, the same components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = union_find(batch.column("a").to_pylist(), batch.column("b").to_pylist())
            linked = [(x, low) for x, low in groups.items() if x != low]
            yield pa.RecordBatch.from_arrays(
                [pa.array([e[i] for e in linked], pa.int64()) for i in (0, 1)], names=["a", "b"]
            )

    return edges.mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of the edges (a, b): root is the component's smallest node.

    The roots themselves, and nodes with no edge but to themselves, are left out.

    Large-star and small-star steps in turn, each written to the shared folder, until nothing
    changes. A step joins every node with its smallest neighbour; no group is ever collected.
    """
    current = materialize(_contracted(edges.where("a <> b")).where("a <> b").distinct())
    before = None
    while True:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            both.join(low, "a")
            .where("b > a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
            .distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b")))
            .distinct()
        )
        current = materialize(small)
        state = current.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if state == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
