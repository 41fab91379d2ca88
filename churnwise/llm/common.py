"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnwise.session import scratch_path


FILE_ROWS = 100_000  # narrow rows in one file of a small table


def written(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage with a table that survives lost executors; the folder is the
    session's ``spark.checkpoint.dir``, and the table goes when the driver ends.  ``rows``
    is the number of rows to expect of a narrow table that was just shuffled: it is written
    in as few files as hold ``FILE_ROWS`` each instead of one per shuffle partition.
    """
    path = scratch_path(df.sparkSession, "written")
    (df if rows is None else df.coalesce(1 + rows // FILE_ROWS)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_memory() -> None:
    """Give freed memory back to the system after a batch: the Python workers of an executor
    live on between tasks, and what they keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def each_text(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of an Arrow string column, one text at a time; null counts as empty."""
    for value in column:
        yield value.as_buffer().to_pybytes() if value.is_valid else b""
    release_memory()


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    if len(sorted_values) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
    return start, np.diff(np.append(start, len(sorted_values)))


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes on the links (a, b) and the smallest node each reaches over these links."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    s, t = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[s], root[t])
        new = root.copy()
        np.minimum.at(new, root[s], low)
        np.minimum.at(new, root[t], low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over (src, dst)."""
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    low = both.groupBy("src").agg(F.min("dst").alias("m"))
    low = low.select("src", F.least("src", "m").alias("m"))
    large = (both.join(low, "src").where(F.col("dst") > F.col("src"))
             .select(F.col("dst").alias("src"), F.col("m").alias("dst"))
             .where(F.col("src") != F.col("dst")).distinct())
    down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    low = down.groupBy("src").agg(F.min("dst").alias("m"))
    linked = down.join(low, "src").where(F.col("dst") != F.col("m")).select(
        F.col("dst").alias("src"), F.col("m").alias("dst"))
    return linked.union(low.select("src", F.col("m").alias("dst"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) of every node on an edge; root is the smallest node reachable.

    ``edges`` has two columns ``src`` and ``dst`` of one orderable type, and about ``rows``
    rows if that is known.  Alternating large-star and small-star steps end in stars around
    the roots after a number of rounds that grows with the logarithm of the longest path.
    Every round is two grouped minima and two joins; the links stay distributed, and each
    round is written so that a lost executor does not undo the rounds before it.
    """
    current = written(edges.where(F.col("src") != F.col("dst")).select(
        F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), rows)
    before = _digest(current)
    while before[0]:
        current = written(_stars(current), before[0])
        now = _digest(current)
        if now == before:
            break
        before = now
    roots = current.select(F.col("dst").alias("node")).distinct()
    return current.select(F.col("src").alias("node"), F.col("dst").alias("root")).union(
        roots.select("node", F.col("node").alias("root")))


def hash_bucket(columns: list[Column], n: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def usable_vector(vector: Column) -> Column:
    """True for vectors that are not null, not zero and hold finite components only."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(finite & some, F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """An Arrow column of equally long vectors as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
