"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "churnwise") -> SparkSession:
    """Return the active session, or build a local one for tests and benches.

    On a cluster the session already exists (spark-submit) and its settings win;
    ``getOrCreate`` then only attaches.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    Read from ``spark.checkpoint.dir`` (set by the cluster).  Where it is unset, a
    local session gets a scratch folder; any other raises, since a folder of one
    machine would lose what the others write.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="churnwise-ckpt-")
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Spark's file systems, if the session is still up."""
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def kept(*tables: DataFrame) -> Iterator[tuple[DataFrame, ...]]:
    """Derived tables that several passes read, kept while the ``with`` block runs.

    Each is computed by the first job that needs it and held on the executors, in memory and
    beyond that on their disks; what a lost executor held is computed again from its lineage.
    On leaving the block, also by an error, nothing stays; a lazy result must be ``finished`` inside it.
    """
    held = tuple(t.persist(StorageLevel.MEMORY_AND_DISK) for t in tables)
    try:
        yield held
    finally:
        for t in held:
            t.unpersist()


def finished(df: DataFrame, ordered: bool = False) -> DataFrame:
    """The rows of ``df``, computed now and read from the shared folder from here on.  A small result
    that is ``ordered`` keeps its order in one file."""
    path = scratch_path(df.sparkSession, "finished")
    (df.coalesce(1) if ordered else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def files_fingerprint(spark: SparkSession, paths: Sequence[str]) -> tuple:
    """Number, size, last change and a digest of (path, size, change) of all files under ``paths``.

    The files are listed by Spark and never opened, so a table of many files is listed by many tasks.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select(
        "path", "length", "modificationTime")
    return tuple(files.agg(F.count(F.lit(1)), F.sum("length"), F.max("modificationTime"), F.sum(
        F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first())


class FittedModels:
    """Models by name and input files: one is trained when it is first asked for and again when the files
    it was trained on have changed since."""

    def __init__(self):
        self._held: dict[tuple, tuple] = {}

    def get(self, spark: SparkSession, name: str, paths: Sequence[str], train: Callable[[], object]):
        key = (spark.sparkContext.applicationId, name, *paths)
        state = files_fingerprint(spark, paths)
        found = self._held.get(key)
        if found is None or found[0] != state:
            self._held[key] = found = (state, train())
        return found[1]

    def clear(self) -> None:
        self._held.clear()
