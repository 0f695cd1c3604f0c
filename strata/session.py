"""Session settings and the shared folder for checkpoints."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar
from typing import TypeVar

from py4j.protocol import Py4JError
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def local_session(cpus: int | str = 8, memory: str = "16g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own session."""
    cores = 8 if cpus == "*" else int(cpus)
    session = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("strata")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        # Listing a table with a directory a day takes a task per directory by default.
        .config("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(4 * cores))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="strata-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_folders: dict[str, Callable[[], None]] = {}


def session_folder(spark: SparkSession) -> str:
    """This application's own folder below the shared one, deleted when the process ends.

    A frame may be read until then, so nothing in it can go earlier by itself; a long-lived
    session calls ``release`` once it needs none of its intermediate results any more. Should the
    process be killed, the folder is left behind under the application's id.
    """
    path = f"{shared_folder(spark)}/strata/{spark.sparkContext.applicationId}"
    if path not in _folders:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())

        def remove() -> None:
            try:
                files.delete(folder, True)
            except (Py4JError, OSError):
                pass  # the JVM has ended before

        _folders[path] = remove
        atexit.register(remove)
    return path


def release(spark: SparkSession) -> None:
    """Delete all intermediate results of this application now."""
    mark = f"/{spark.sparkContext.applicationId}"
    for path, remove in _folders.items():
        if path.endswith(mark):
            remove()


_steps: ContextVar[list[str] | None] = ContextVar("steps", default=None)


@contextmanager
def temporary_steps(spark: SparkSession) -> Iterator[None]:
    """Delete what ``materialize`` writes inside the block, once the block has published it."""
    written: list[str] = []
    token = _steps.set(written)
    try:
        yield
    finally:
        _steps.reset(token)
        for path in written:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def side_by_side(
    spark: SparkSession, builds: Iterable[Callable[[], T]], at_once: int
) -> list[T]:
    """Results of independent builds, up to ``at_once`` of them submitting Spark jobs together.

    Small tables then fill executors that a single job would leave idle. The first failure, in
    the given order, is raised after the builds that have begun.
    """
    builds = list(builds)
    if at_once <= 1 or len(builds) <= 1:
        return [build() for build in builds]
    with ThreadPoolExecutor(at_once) as pool:
        begun = [pool.submit(inheritable_thread_target(spark)(build)) for build in builds]
        try:
            return [future.result() for future in begun]
        except BaseException:
            for future in begun:
                future.cancel()
            raise


#: Spark's setting that deletes the shuffle files of an execution as soon as it has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_freeing: dict[str, tuple[int, str | None]] = {}
_freeing_lock = threading.Lock()


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside the block, the shuffle files of an execution are deleted as soon as it has ended.

    Otherwise they stay until the driver happens to collect its garbage, and a run of many steps
    holds the shuffles of all of them on disk beside the tables it writes. A frame that is executed
    again shuffles again. Blocks may be nested or lie in several threads; the last to end puts the
    setting back.
    """
    session = spark._jsparkSession.sessionUUID()
    with _freeing_lock:
        depth, before = _freeing.get(session, (0, spark.conf.get(FREE_SHUFFLES, None)))
        _freeing[session] = (depth + 1, before)
        spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        with _freeing_lock:
            depth, before = _freeing.pop(session)
            if depth > 1:
                _freeing[session] = (depth - 1, before)
            elif before is None:
                spark.conf.unset(FREE_SHUFFLES)
            else:
                spark.conf.set(FREE_SHUFFLES, before)


#: What Parquet files are compressed with: a quarter smaller than with Spark's default.
COMPRESSION = "zstd"


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage like a checkpoint, so lost executors cost nothing that was done before, but
    as Parquet: later steps read only the columns they need and plan with the real size.
    """
    path = f"{session_folder(df.sparkSession)}/steps/{uuid.uuid4().hex}"
    if (written := _steps.get()) is not None:
        written.append(path)
    df.write.option("compression", COMPRESSION).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
