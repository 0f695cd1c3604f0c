"""Tables as published sets of Parquet directories, or as catalog tables.

A path table is a folder of write generations (``_gen=1``, ``_gen=2``, ...) and a numbered
publication file that names the directories making up the table. A write puts its files into a
new generation and then publishes a new list, which may keep any directories of the old one. So
a reader sees either the old or the new table, a write may read the table it replaces, and a
merge rewrites only the directories it touches. One writer per table is assumed; a second writer
of the same version fails instead of overwriting. This is a write convention on plain Parquet:
there is no log and no concurrency control beyond that.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.session import COMPRESSION

LAYERS = ("bronze", "silver", "gold", "quarantine", "stage", "held")
GEN = "_gen"
DIRECTORY = "_directory"


@dataclass(frozen=True)
class Published:
    """One published state.

    ``dirs`` are the partition directories, relative to ``base``; ``sizes`` says how many of them
    each generation has on disk. ``consumed`` is the ledger of source generations this state
    already includes; ``inputs`` notes what it was built from; ``high`` is the greatest value that a
    column of numbers ever had, in rows long gone too.
    """

    version: int
    base: str
    dirs: tuple[str, ...]
    schema: T.StructType
    partition_by: tuple[str, ...] = ()
    consumed: tuple[str, ...] = ()
    sizes: dict[str, int] = field(default_factory=dict)
    inputs: dict[str, int] = field(default_factory=dict)
    #: The greatest generation number ever published, dropped generations included.
    last: int = field(default=0, compare=False)
    high: dict[str, int] = field(default_factory=dict)

    def paths(self, dirs: list[str]) -> list[str]:
        """Paths to scan for ``dirs``: a generation that is needed whole is named once."""
        wanted = Counter(generation_of(d) for d in dirs)
        whole = {g for g, n in wanted.items() if n == self.sizes.get(g)}
        parts = [d for d in dirs if generation_of(d) not in whole]
        return [f"{self.base}/{d}" for d in [*sorted(whole), *parts]]


@dataclass(frozen=True)
class Written:
    """What a write produced: its generation and the observed metrics."""

    generation: str
    metrics: dict = field(default_factory=dict)
    published: bool = True


def generation_of(directory: str) -> str:
    return directory.split("/", 1)[0]


class Tables:
    """Tables below a root directory that all executors can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # -- addresses ------------------------------------------------------------------

    def base(self, layer: str, table: str) -> str:
        return f"{self.root}/{layer}/{table}"

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _children(self, path: str) -> list[str]:
        fs, where = self._fs(), self._path(path)
        if not fs.exists(where):
            return []
        return sorted(status.getPath().getName() for status in fs.listStatus(where))

    # -- publication files ----------------------------------------------------------

    def published(self, layer: str, table: str, version: int | None = None) -> Published | None:
        """The current publication, or an earlier one that has not been pruned."""
        folder = f"{self.base(layer, table)}/_published"
        names = [n for n in self._children(folder) if n.endswith(".json")]
        if version is not None:
            names = [n for n in names if n == f"{version:08d}.json"]
        if not names:
            return None
        stream = self._fs().open(self._path(f"{folder}/{names[-1]}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        state = json.loads(text)
        return Published(
            version=state["version"],
            base=self.root + "/" + state["base"],
            dirs=tuple(state["dirs"]),
            schema=T.StructType.fromJson(state["schema"]),
            partition_by=tuple(state["partition_by"]),
            consumed=tuple(state["consumed"]),
            sizes=state["sizes"],
            inputs=state["inputs"],
            last=state.get("last", 0),
            high=state.get("high", {}),
        )

    def _publish(self, layer: str, table: str, state: Published) -> None:
        folder = f"{self.base(layer, table)}/_published"
        before = self.published(layer, table)
        numbers = [int(g.split("=")[1]) for g in state.sizes]
        high = dict(before.high) if before else {}
        for column, value in state.high.items():
            high[column] = max(value, high.get(column, value))
        body = json.dumps(
            {
                "version": state.version,
                "base": state.base[len(self.root) + 1 :],
                "dirs": list(state.dirs),
                "schema": state.schema.jsonValue(),
                "partition_by": list(state.partition_by),
                "consumed": list(state.consumed),
                "sizes": {g: state.sizes[g] for g in {generation_of(d) for d in state.dirs}},
                "inputs": state.inputs,
                "last": max([state.last, before.last if before else 0, *numbers]),
                "high": high,
            }
        )
        fs = self._fs()
        draft = self._path(f"{folder}/.{state.version:08d}.draft")
        final = self._path(f"{folder}/{state.version:08d}.json")
        if fs.exists(final):
            raise RuntimeError(f"{layer}.{table} version {state.version} was published meanwhile")
        stream = fs.create(draft, True)
        try:
            stream.write(bytearray(body, "utf-8"))
        finally:
            stream.close()
        if not fs.rename(draft, final):
            raise RuntimeError(f"{layer}.{table} version {state.version} could not be published")

    # -- reading --------------------------------------------------------------------

    def exists(self, layer: str, table: str) -> bool:
        return self.published(layer, table) is not None

    def list(self, layer: str) -> list[str]:
        return [t for t in self._children(f"{self.root}/{layer}") if self.exists(layer, t)]

    def generations(self, layer: str, table: str) -> list[str]:
        state = self.published(layer, table)
        return list(dict.fromkeys(generation_of(d) for d in state.dirs)) if state else []

    def readable(self, layer: str, table: str, version: int) -> bool:
        """Whether an earlier publication is still there with all its generations."""
        state = self.published(layer, table, version)
        if state is None:
            return False
        there = set(self._children(state.base))
        return all(generation_of(d) in there for d in state.dirs)

    def read(
        self,
        layer: str,
        table: str,
        only: Callable[[str], bool] | None = None,
        with_directory: bool = False,
        version: int | None = None,
    ) -> DataFrame:
        """The published table, or the directories of it that ``only`` accepts.

        ``with_directory`` adds the published directory of each row as ``_directory``; ``version``
        asks for an earlier publication.
        """
        state = self.published(layer, table, version)
        if state is None:
            raise FileNotFoundError(f"table {layer}.{table} has not been published in {self.root}")
        dirs = [d for d in state.dirs if only is None or only(d)]
        columns = [F.col(c) for c in state.schema.names]
        if not dirs:
            empty = self.spark.createDataFrame([], state.schema)
            return empty.withColumn(DIRECTORY, F.lit("")) if with_directory else empty
        rows = (
            self.spark.read.schema(state.schema)
            .option("basePath", state.base)
            .parquet(*state.paths(dirs))
        )
        if with_directory:
            columns.append(_directory(F.col("_metadata.file_path"), dirs).alias(DIRECTORY))
        return rows.select(*columns)

    # -- writing --------------------------------------------------------------------

    def write(
        self,
        df: DataFrame,
        layer: str,
        table: str,
        keep: Callable[[str], bool] | None = None,
        partition_by: Iterable[str] = (),
        consumed: Iterable[str] = (),
        metrics: Iterable[Column] = (),
        inputs: dict[str, int] | None = None,
        numbered: str | None = None,
    ) -> Written:
        """Write ``df`` as a new generation and publish it next to the directories ``keep`` keeps.

        By default nothing is kept, which replaces the table. ``consumed`` extends the ledger in
        the same publication. ``metrics`` are aggregates observed during the write itself.
        ``numbered`` names a column of numbers whose greatest value ever is to be remembered.
        """
        state = self.published(layer, table)
        base, partition_by = self.base(layer, table), tuple(partition_by)
        generation = self._next_generation(layer, table)
        metrics = tuple(metrics)
        if numbered:
            metrics = (*metrics, F.max(numbered).alias("_greatest"))
        observed = self._store(df, f"{base}/{generation}", partition_by, metrics)
        greatest = observed.pop("_greatest", None)
        kept = [d for d in state.dirs if keep(d)] if state and keep else []
        if kept and state.base != base:
            raise ValueError(f"{layer}.{table} publishes the files of {state.base}")
        if kept and state.schema.names != df.columns:
            raise ValueError(f"{layer}.{table}: columns {df.columns} differ from {state.schema.names}")
        written = self._leaves(f"{base}/{generation}", len(partition_by))
        self._publish(
            layer,
            table,
            Published(
                version=state.version + 1 if state else 1,
                base=base,
                dirs=tuple(kept + [f"{generation}/{leaf}".rstrip("/") for leaf in written]),
                schema=_nullable(df.schema),
                partition_by=partition_by,
                consumed=tuple(dict.fromkeys([*(state.consumed if state else ()), *consumed])),
                sizes={**(state.sizes if state else {}), generation: len(written)},
                inputs=inputs or {},
                high={} if greatest is None else {numbered: greatest},
            ),
        )
        return Written(generation, observed)

    def append(self, df: DataFrame, layer: str, table: str, **options) -> Written:
        return self.write(df, layer, table, keep=lambda d: True, **options)

    def write_split(
        self,
        df: DataFrame,
        flag: str,
        accepted: tuple[str, str],
        rejected: tuple[str, str],
        partition_by: Iterable[str] = (),
        metrics: Iterable[Column] = (),
        drop_accepted: Iterable[str] = (),
        consumed: Iterable[str] = (),
        replace_rejected: bool = False,
        accept: Callable[[dict], bool] | None = None,
        held: tuple[str, str] | None = None,
    ) -> Written:
        """Append one frame to two tables in a single pass, split by the boolean column ``flag``.

        Both sides are partitions of one generation; each table publishes its own side, and
        ``replace_rejected`` lets the new rejects take the place of the old ones. ``accept`` is asked
        about the metrics observed during the write; what it refuses is published in neither table
        but whole in the table ``held``, until ``publish_held`` or ``drop_directories`` decides.
        """
        base, partition_by = self.base(*accepted), tuple(partition_by)
        generation = self._next_generation(*accepted)
        observed = self._store(df, f"{base}/{generation}", (flag, *partition_by), tuple(metrics))
        leaves = self._leaves(f"{base}/{generation}", 1 + len(partition_by))
        schema = _nullable(df.drop(flag).schema)
        dirs = [f"{generation}/{leaf}" for leaf in leaves]
        if accept is not None and not accept(observed):
            self._show(held, base, dirs, schema, partition_by, len(leaves))
            return Written(generation, observed, published=False)
        self._split(
            flag, base, dirs, schema, partition_by, accepted, rejected, drop_accepted, consumed,
            replace_rejected,
        )
        return Written(generation, observed)

    def _split(
        self, flag, base, dirs, schema, partition_by, accepted, rejected, drop_accepted, consumed=(),
        replace_rejected=False,
    ) -> None:
        narrow = T.StructType([f for f in schema.fields if f.name not in set(drop_accepted)])
        for side, address, columns in (("true", accepted, narrow), ("false", rejected, schema)):
            mine = [d for d in dirs if d.split("/")[1] == f"{flag}={side}"]
            renewed = replace_rejected and side == "false"
            if side == "false" and not mine and not renewed:
                continue
            self._show(address, base, mine, columns, partition_by, len(dirs), consumed, renewed)

    def _show(
        self, address, base, dirs, schema, partition_by, size, consumed=(), instead=False
    ) -> None:
        """Publish directories of one generation in a table, next to or instead of what it shows."""
        state = self.published(*address)
        if state and state.base != base:
            raise ValueError(f"{'.'.join(address)} is kept elsewhere: {state.base}")
        before = state.dirs if state and not instead else ()
        generations = {generation_of(d): size for d in dirs}
        self._publish(
            *address,
            Published(
                version=state.version + 1 if state else 1,
                base=base,
                dirs=(*before, *[d for d in dirs if d not in before]),
                schema=schema,
                partition_by=partition_by,
                consumed=(*(state.consumed if state else ()), *consumed),
                sizes={**(state.sizes if state else {}), **generations},
            ),
        )

    def publish_held(
        self,
        held: tuple[str, str],
        generation: str,
        flag: str,
        accepted: tuple[str, str],
        rejected: tuple[str, str],
        drop_accepted: Iterable[str] = (),
    ) -> None:
        """Give a held generation to the tables it was meant for. Repeated after a failure, it goes on."""
        state = self.published(*held)
        dirs = [d for d in state.dirs if generation_of(d) == generation]
        if not dirs:
            raise ValueError(f"{'.'.join(held)} holds no {generation}")
        self._split(flag, state.base, dirs, state.schema, state.partition_by, accepted, rejected, drop_accepted)
        self.drop_directories(*held, lambda d: generation_of(d) == generation)

    def publish_as(self, source: tuple[str, str], layer: str, table: str) -> None:
        """Publish the files of one table under another name, without copying them."""
        shown, state = self.published(*source), self.published(layer, table)
        version = state.version + 1 if state else 1
        named = replace(shown, version=version, consumed=(), inputs={".".join(source): shown.version})
        if state is None or replace(state, version=version) != named:
            self._publish(layer, table, named)

    def register(self, layer: str) -> list[str]:
        """Temporary views ``<layer>_<table>`` over the published tables, for SQL."""
        names = self.list(layer)
        for table in names:
            self.read(layer, table).createOrReplaceTempView(f"{layer}_{table}")
        return names

    def next_number(self, layer: str, table: str, column: str) -> int:
        """One more than the greatest value the column ever had: numbers are not given twice."""
        state = self.published(layer, table)
        if state is None:
            return 0
        if column in state.high:
            return state.high[column] + 1
        return self.read(layer, table).agg(F.coalesce(F.max(column) + 1, F.lit(0))).first()[0]

    def there(self, path: str) -> bool:
        where = self._path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def note_inputs(self, layer: str, table: str, inputs: dict[str, int]) -> None:
        """Publish that the table, as it is, is what these inputs give."""
        state = self.published(layer, table)
        if state.inputs != inputs:
            self._publish(layer, table, replace(state, version=state.version + 1, inputs=inputs))

    def mark_consumed(self, layer: str, table: str, consumed: Iterable[str]) -> None:
        """Extend the ledger without changing the data."""
        self._republish(layer, table, lambda d: True, consumed)

    def drop_directories(self, layer: str, table: str, drop: Callable[[str], bool]) -> None:
        """Publish the table without some directories; no data is rewritten."""
        self._republish(layer, table, lambda d: not drop(d))

    def replace_partition(
        self, df: DataFrame | None, layer: str, table: str, column: str, value: object
    ) -> None:
        """Replace (or with ``None`` remove) one value of a partition column."""
        state = self.published(layer, table)
        mark = f"{column}={value}"
        if state is None or column not in state.partition_by:
            raise ValueError(f"{layer}.{table} is not partitioned by {column}")
        if df is None:
            self.drop_directories(layer, table, lambda d: mark in d.split("/"))
            return
        self.write(
            df,
            layer,
            table,
            keep=lambda d: mark not in d.split("/"),
            partition_by=state.partition_by,
        )

    def prune(self, layer: str, table: str) -> list[str]:
        """Delete publications before the last and generations that it does not name.

        Quarantine and held batches publish directories of bronze generations, and gold dimensions
        may publish silver files; all count as use.

        Call it only when no reader is still using an earlier publication.
        """
        base = self.base(layer, table)
        sharing = [(layer, table), ("quarantine", table), ("held", table), ("gold", f"dim_{table}")]
        states = [state for address in sharing if (state := self.published(*address))]
        used = {generation_of(d) for state in states if state.base == base for d in state.dirs}
        stale = [n for n in self._children(base) if n.startswith(f"{GEN}=") and n not in used]
        for name in stale:
            self._fs().delete(self._path(f"{base}/{name}"), True)
        for older in [n for n in self._children(f"{base}/_published") if n.endswith(".json")][:-1]:
            self._fs().delete(self._path(f"{base}/_published/{older}"), False)
        return stale

    # -- helpers --------------------------------------------------------------------

    def _republish(self, layer, table, keep, consumed=()) -> None:
        state = self.published(layer, table)
        self._publish(
            layer,
            table,
            Published(
                version=state.version + 1,
                base=state.base,
                dirs=tuple(d for d in state.dirs if keep(d)),
                schema=state.schema,
                partition_by=state.partition_by,
                consumed=tuple(dict.fromkeys([*state.consumed, *consumed])),
                sizes=state.sizes,
                inputs=state.inputs,
            ),
        )

    def _next_generation(self, layer: str, table: str) -> str:
        taken = [
            int(n.split("=")[1])
            for n in self._children(self.base(layer, table))
            if n.startswith(f"{GEN}=")
        ]
        # A number once published is in ledgers of other tables and never used again.
        state = self.published(layer, table)
        taken.append(state.last if state else 0)
        return f"{GEN}={max(taken, default=0) + 1}"

    def _store(self, df, path, partition_by, metrics) -> dict:
        observation = Observation() if metrics else None
        if observation is not None:
            df = df.observe(observation, *metrics)
        writer = df.write.mode("errorifexists").option("compression", COMPRESSION)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        return dict(observation.get) if observation is not None else {}

    def _leaves(self, path: str, depth: int) -> list[str]:
        """Partition directories ``depth`` levels below ``path``; ``[""]`` for depth 0."""
        found = [""]
        for _ in range(depth):
            found = [
                f"{parent}/{child}".lstrip("/")
                for parent in found
                for child in self._children(f"{path}/{parent}".rstrip("/"))
                if "=" in child
            ]
        return found


def touched_directories(
    rows: DataFrame, source: DataFrame, key: list[str], partition_by: Iterable[str] = ()
) -> set[str]:
    """Published directories of ``rows`` (read ``with_directory``) that hold a key of ``source``.

    Only the key columns are read, and of those only row groups within the source's least and
    greatest keys. A partition column that is part of the key cuts the scan to the partition
    values of the source. The result has at most one entry per directory.
    """
    for column in partition_by:
        if column in key:
            values = [row[0] for row in source.select(column).distinct().collect()]
            rows = rows.where(F.col(column).isin(values))
    bounds = source.agg(
        *[F.min(k).alias(f"lo_{i}") for i, k in enumerate(key)],
        *[F.max(k).alias(f"hi_{i}") for i, k in enumerate(key)],
    ).first()
    for i, k in enumerate(key):
        if bounds[f"lo_{i}"] is not None:
            rows = rows.where(F.col(k).between(bounds[f"lo_{i}"], bounds[f"hi_{i}"]))
    hit = rows.select(*key, DIRECTORY).join(source.select(*key), key, "left_semi")
    return {unquote(row[0]) for row in hit.select(DIRECTORY).distinct().collect()}


def _directory(file: Column, dirs: list[str]) -> Column:
    """The published directory of a file: as many levels above it as the directories have.

    Only directories of different depths need a pattern, which takes much longer for each row.
    """
    depths = {d.count("/") + 1 for d in dirs}
    if len(depths) > 1:
        return F.regexp_extract(file, rf"({GEN}=\d+(?:/[^/]+=[^/]+)*)/[^/]+$", 1)
    inside = F.substring_index(file, "/", -(depths.pop() + 1))
    name = F.length(F.substring_index(file, "/", -1))
    return F.left(inside, F.length(inside) - name - F.lit(1))


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
