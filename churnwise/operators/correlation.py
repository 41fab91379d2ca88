"""Correlation matrices of wide tables (D19) in one pass.

A pair's correlation counts the rows where both values are present, so n columns with nulls need about
n^2 / 2 counts, means and co-moments.  As separate aggregates they fall out of code generation beyond a few
dozen columns; here every task multiplies slices of its rows by their presence masks instead (one matrix
product gives a sum for all pairs) and hands on one row per pair.

Moments are taken about the mean of each slice and merged by the parallel update of Chan, Golub and LeVeque
(1979), in the task and again over the tasks, so a large offset of a column costs no digits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICE_ROWS = 4096  # rows multiplied at once
MOST_COLUMNS = 2048  # a task holds four matrices of columns x columns doubles
DOUBTFUL = 1e-9  # a variance this small beside the slice's squares is computed again from the pair's own rows


def _slice_moments(x: np.ndarray, have: np.ndarray) -> tuple[np.ndarray, ...]:
    """(n, mean, var, cov) per pair over the rows where both columns are present: ``mean[i, j]`` and ``var[i, j]``
    (a sum of squares) are of column i, ``cov`` is symmetric."""
    m = have.astype(np.float64)
    rows = m.sum(axis=0)
    safe = np.where(have, x, 0.0)
    # scaled by the count first: values near the largest double do not overflow the sum
    shift = (safe / np.maximum(rows, 1.0)).sum(axis=0)
    low = np.where(have, x, np.inf).min(axis=0, initial=np.inf)
    high = np.where(have, x, -np.inf).max(axis=0, initial=-np.inf)
    shift = np.where(low == high, low, shift)  # a constant stays exact
    d = np.where(have, x - shift, 0.0)
    n = m.T @ m
    per = np.maximum(n, 1.0)
    s, q, p = d.T @ m, (d * d).T @ m, d.T @ d
    mean = shift[:, None] + s / per
    var = np.maximum(q - s * s / per, 0.0)
    cov = p - s * s.T / per
    for i, j in np.argwhere((var <= DOUBTFUL * q) & (n > 0) & (q > 0)):
        own = x[have[:, i] & have[:, j]][:, [i, j]]
        middle = np.where(own.min(axis=0) == own.max(axis=0), own[0], own.mean(axis=0))
        own = own - middle
        mean[i, j], mean[j, i] = middle
        var[i, j], var[j, i] = (own * own).sum(axis=0)
        cov[i, j] = cov[j, i] = (own[:, 0] * own[:, 1]).sum()
    return n, mean, var, cov


def _merged(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    n = a[0] + b[0]
    per = np.maximum(n, 1.0)
    step = np.where(b[0] > 0, np.where(a[0] > 0, b[1] - a[1], 0.0), 0.0)
    both = a[0] * b[0] / per
    mean = np.where(a[0] > 0, a[1] + step * (b[0] / per), b[1])
    return n, mean, a[2] + b[2] + step * step * both, a[3] + b[3] + step * step.T * both


def pair_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(i, j, n, mean_a, mean_b, var_a, var_b, cov, odd) per task and pair i <= j of ``cols``.

    ``odd`` counts the pair's rows with a NaN or an infinity, which make its correlation NaN; the moments are
    of the other rows.
    """
    k = len(cols)
    upper_i, upper_j = np.triu_indices(k)
    schema = ("i int, j int, n double, mean_a double, mean_b double, var_a double, var_b double, cov double, "
              "odd double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, odd = None, np.zeros((k, k))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                present = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in part.columns], axis=1)
                x = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in part.columns], axis=1)
                wild = present & ~np.isfinite(x)
                if wild.any():
                    w, m = wild.astype(np.float64), present.astype(np.float64)
                    odd += w.T @ m + m.T @ w
                    present = present & ~wild
                    x = np.where(wild, 0.0, x)
                found = _slice_moments(x, present)
                total = found if total is None else _merged(total, found)
        if total is None:
            return
        n, mean, var, cov = total
        u = (upper_i, upper_j)
        yield pa.RecordBatch.from_arrays(
            [pa.array(upper_i.astype(np.int32)), pa.array(upper_j.astype(np.int32)), pa.array(n[u]),
             pa.array(mean[u]), pa.array(mean.T[u]), pa.array(var[u]), pa.array(var.T[u]), pa.array(cov[u]),
             pa.array(odd[u])],
            names=["i", "j", "n", "mean_a", "mean_b", "var_a", "var_b", "cov", "odd"])

    return df.select(*[F.col("`" + c.replace("`", "``") + "`").cast("double").alias(f"_{i}") for i, c in enumerate(cols)]).mapInArrow(
        run, schema)


def wide_correlation(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long form ``(col_a, col_b, corr)`` for every ordered pair of ``cols``, in one pass over ``df``.

    Null where fewer than two rows hold both values or one of them is constant there, NaN where a NaN or an
    infinity takes part; an empty table gives every pair with null.
    """
    cols = list(cols)
    if len(cols) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns")
    spark = df.sparkSession
    # offsets from one task's mean of the pair, which lies among the data
    pair = Window.partitionBy("i", "j")
    seen = pair_moments(df, cols).where((F.col("n") > 0) | (F.col("odd") > 0)).select(
        "*", *[(F.col(m) - F.min(F.when(F.col("n") > 0, F.col(m))).over(pair)).alias(d)
               for m, d in (("mean_a", "da"), ("mean_b", "db"))])
    n = F.sum("n")

    def moment(inner: str, a: str, b: str):
        about = F.try_divide(F.sum(F.col("n") * F.col(a)), n) * F.sum(F.col("n") * F.col(b))
        return F.sum(F.col(inner) + F.col("n") * F.col(a) * F.col(b)) - F.coalesce(about, F.lit(0.0))

    one = seen.groupBy("i", "j").agg(n.alias("n"), moment("var_a", "da", "da").alias("va"),
                                     moment("var_b", "db", "db").alias("vb"), moment("cov", "da", "db").alias("c"),
                                     F.sum("odd").alias("odd"))
    scale = F.sqrt(F.greatest("va", F.lit(0.0))) * F.sqrt(F.greatest("vb", F.lit(0.0)))
    found = one.select("i", "j", F.when(F.col("odd") > 0, F.lit(float("nan"))).when(
        F.col("n") >= 2, F.try_divide("c", scale)).alias("corr"))
    both = found.select(F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(
        F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))).alias("p"), "corr")
    names = F.array(*[F.lit(c) for c in cols])
    k = F.lit(len(cols))
    cells = spark.range(len(cols) * len(cols)).select(F.floor(F.col("id") / k).cast("int").alias("i"),
                                                      (F.col("id") % k).cast("int").alias("j"))
    return cells.join(both.select("p.i", "p.j", "corr"), ["i", "j"], "left").select(
        F.get(names, F.col("i")).alias("col_a"), F.get(names, F.col("j")).alias("col_b"), "corr")
