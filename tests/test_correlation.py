"""Correlation matrices of wide tables against numpy, pair by pair."""

import numpy as np
import pyarrow as pa
import pytest

from churnwise.operators import stats
from churnwise.operators.correlation import wide_correlation


def brute(x):
    k = x.shape[1]
    out = np.full((k, k), np.nan)
    for i in range(k):
        for j in range(k):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[both, i], x[both, j]
            if len(a) >= 2 and a.min() < a.max() and b.min() < b.max():
                out[i, j] = np.corrcoef(a, b)[0, 1]
    return out


def matrix(df, names):
    at = {c: i for i, c in enumerate(names)}
    out = np.full((len(names), len(names)), np.inf)
    for r in df.collect():
        out[at[r["col_a"]], at[r["col_b"]]] = np.nan if r["corr"] is None else r["corr"]
    return out


def table(spark, x, names, parts):
    cols = [pa.array(x[:, i], from_pandas=True) for i in range(x.shape[1])]  # NaN becomes null
    return spark.createDataFrame(pa.table(cols, names=names)).repartition(parts)


@pytest.mark.parametrize("parts", [1, 7])
def test_two_hundred_columns_with_nulls(spark, parts):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(9000, 6))
    x = base @ rng.normal(size=(6, 200)) + rng.normal(size=(9000, 200))
    x *= 10.0 ** rng.integers(-6, 7, 200)
    x += 10.0 ** rng.integers(0, 7, 200) * np.abs(x).mean(axis=0)  # offsets far beyond the spread
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:, 3] = 0.1  # constant
    x[:, 4] = np.nan  # never present
    x[:, 5] = np.where(rng.random(9000) < 0.5, x[:, 5], np.nan)
    x[:, 6] = np.where(np.isnan(x[:, 5]), x[:, 6], 0.3)  # constant where column 5 is present
    x[1:, 7] = np.nan  # present once
    names = [f"c {i}" for i in range(200)]
    df = stats.correlation_matrix(table(spark, x, names, parts), names)
    assert df.count() == 200 * 200
    got, want = matrix(df, names), brute(x)
    assert np.array_equal(np.isnan(got), np.isnan(want))
    np.testing.assert_allclose(got, want, atol=1e-8)
    assert np.array_equal(got, got.T, equal_nan=True)


def test_equals_the_narrow_form(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 5))
    x[rng.random(x.shape) < 0.2] = np.nan
    names = list("abcde")
    df = table(spark, x, names, 3)
    np.testing.assert_allclose(matrix(wide_correlation(df, names), names), matrix(stats.correlation_matrix(df), names),
                               atol=1e-12)


def test_one_pass_over_the_input(spark, tmp_path):
    names = [f"c{i}" for i in range(40)]
    table(spark, np.arange(400.0).reshape(10, 40), names, 2).write.parquet(f"{tmp_path}/t")
    df = stats.correlation_matrix(spark.read.parquet(f"{tmp_path}/t"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1 and plan.count("MapInArrow") == 1


def test_odd_tables(spark):
    names = ["a", "b`c"]
    empty = spark.createDataFrame([], "a double, `b``c` int, text string")
    assert np.isnan(matrix(wide_correlation(empty, names), names)).all()
    wild = spark.createDataFrame([(1.0, 2), (float("nan"), None), (3.0, 5), (2.0, 7)], "a double, `b``c` int")
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in wide_correlation(wild, names).collect()}
    assert np.isnan(got["a", "a"])  # a NaN takes part
    assert got["a", "b`c"] == pytest.approx(np.corrcoef([1, 3, 2], [2, 5, 7])[0, 1])  # not in this pair
    assert got["b`c", "b`c"] == pytest.approx(1.0)
