"""Session settings, and where intermediate results are written."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even if the next aggregation then needs its own shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Rows hold whole texts: ten thousand of them would be a lot for one Arrow batch.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings this library counts on to a session made elsewhere."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pairlake")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and scratch tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back
    to a folder of this machine; anywhere else a lost executor would lose the data.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not named and not sc.getCheckpointDir() and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="pairlake-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from there.

    The written table cuts the lineage: lost executors reread it instead of recomputing
    the steps before. Parquet keeps later reads narrow and tells the planner real sizes.
    """
    spark = df.sparkSession
    path = scratch(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for a table written between two jobs."""
    return os.path.join(scratch_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")


@contextmanager
def beside(spark: SparkSession, work: Callable[[], T]) -> Iterator[Future[T]]:
    """``work`` runs in a thread of its own while the block runs; its jobs fill the cores that
    short jobs of the block leave idle. What it writes belongs to the caller's scope."""
    scratch_root(spark)  # set here once, not by both threads
    with ThreadPoolExecutor(1) as pool:
        yield pool.submit(inheritable_thread_target(spark)(copy_context().run), work)


# The folder of the job that is running here: every thread and stream has its own.
_SCOPE: ContextVar[str] = ContextVar("pairlake_scope", default="")


def scratch_root(spark: SparkSession) -> str:
    app = os.path.join(shared_dir(spark), f"pairlake-{spark.sparkContext.applicationId}")
    if app not in _DOOMED:
        _DOOMED.add(app)
        path, files = _file_system(spark, app)
        files.deleteOnExit(path)  # what a job has not deleted goes when the driver ends
    return os.path.join(app, _SCOPE.get())


_DOOMED: set[str] = set()


def _file_system(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, folder: str) -> bool:
    path, files = _file_system(spark, folder)
    return files.exists(path)


def folders(spark: SparkSession, parent: str) -> list[tuple[str, bool]]:
    """(name, written to its end) of the folders in ``parent``; none if it does not exist."""
    path, files = _file_system(spark, parent)
    if not files.exists(path):
        return []
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = [f.getPath() for f in files.listStatus(path) if f.isDirectory()]
    return [(f.getName(), files.exists(done(f, "_SUCCESS"))) for f in found]


def remove(spark: SparkSession, folder: str) -> None:
    _drop(spark, folder)


def drop_scratch(spark: SparkSession) -> None:
    """Delete what the running scope (outside of any: this application) has written."""
    _drop(spark, scratch_root(spark))


def _drop(spark: SparkSession, folder: str) -> None:
    path, files = _file_system(spark, folder)
    files.delete(path, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[str]:
    """Tables cut inside the scope are deleted at its end; the scope's folder is its value.

    Scopes nest, and belong to the thread that opened them: streams and jobs that run side
    by side never see or delete each other's tables.
    """
    token = _SCOPE.set(os.path.join(_SCOPE.get(), f"scope-{uuid.uuid4().hex[:12]}"))
    folder = scratch_root(spark)
    try:
        yield folder
    finally:
        _drop(spark, folder)
        _SCOPE.reset(token)
