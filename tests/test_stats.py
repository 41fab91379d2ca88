"""Aggregations on hand rows and against DuckDB on random data."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from churnwise.operators import model, rollups, stats
from churnwise.operators.quantiles import quantiles


def test_quantile_interpolates(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 4, 10)], "x double")
    got = quantiles(df, "x", [0.7]).first()["value"]
    assert got == pytest.approx(4.6)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 150, 3000])
@pytest.mark.parametrize("broadcast", [True, False])
def test_quantiles_match_duckdb(spark, n, broadcast):
    rnd = random.Random(n)
    rows = [(rnd.choice("abc"), rnd.choice([float(rnd.randint(-50, 50)), rnd.uniform(-1e-9, 1e9)])
             if rnd.random() > 0.05 else None) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.7, 0.9, 1.0]
    got = {(r["g"], r["p"]): r["value"]
           for r in quantiles(df, "x", probs, by=["g"], broadcast=broadcast).collect()}
    glob = {r["p"]: r["value"] for r in quantiles(df, "x", probs).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "x"])  # noqa: F841
    con = duckdb.connect()
    for p in probs:
        for g, v in con.execute(
                f"SELECT g, quantile_cont(x, {p}) FROM pdf WHERE x IS NOT NULL GROUP BY g").fetchall():
            assert got[(g, p)] == pytest.approx(v, rel=1e-12, abs=1e-9), (g, p)
        v = con.execute(f"SELECT quantile_cont(x, {p}) FROM pdf").fetchone()[0]
        assert glob[p] == (pytest.approx(v, rel=1e-12, abs=1e-9) if v is not None else None)


@pytest.mark.parametrize("values", [[], [None, None], [float("nan"), None]])
def test_no_values_give_nulls(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r["value"] for r in quantiles(df, "x", [0.2, 0.5]).collect()] == [None, None]
    assert [r["value"] for r in quantiles(df, "x", [0.5], exact=False).collect()] == [None]
    assert quantiles(df.selectExpr("'g' AS g", "x"), "x", [0.5], by=["g"]).count() == 0
    d = stats.describe_column(df, "x").first()
    assert (d["mean"], d["std"], d["min"], d["max"], d["median"]) == (None,) * 5
    rolled = rollups.assign_segment(df.selectExpr("x AS total_purchase_amount"))
    assert {r["customer_segment"] for r in rolled.collect()} <= {"regular"}


def test_quantiles_skip_nan_and_order_extremes(spark):
    inf = float("inf")
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, float("nan"), -inf, inf, -0.0, 5e-324, -1e308)], "x double")
    got = [r["value"] for r in quantiles(df, "x", [0.0, 1 / 6, 2 / 6, 0.5, 4 / 6, 5 / 6, 1.0]).collect()]
    assert got == [-inf, -1e308, 0.0, 5e-324, 1.0, 2.0, inf]
    assert stats.null_counts(df).first()["null_count"] == 1


def test_describe_matches_numpy(spark):
    x = np.random.default_rng(1).lognormal(3, 2, 2000)
    d = stats.describe_column(spark.createDataFrame([(float(v),) for v in x], "x double").repartition(5), "x").first()
    assert d["mean"] == pytest.approx(x.mean()) and d["std"] == pytest.approx(x.std(ddof=1))
    assert (d["min"], d["max"]) == (x.min(), x.max()) and d["median"] == pytest.approx(np.median(x))


@pytest.mark.parametrize("values,bins", [
    ([round(1 + i * 0.1, 1) for i in range(41)], 20), ([round(1 + i * 0.1, 1) for i in range(41)], 11),
    ([float(i % 11) for i in range(100)], 11), ([7.0] * 5, 10), ([0.1 * i for i in range(97)], 30), ([-1.5, 2.5], 50)])
def test_histogram_bins_like_numpy(spark, values, bins):
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "x double")
    got = stats.histogram(df, "x", bins=bins).orderBy("bin").collect()
    count, edges = np.histogram(values, bins)
    assert [r["count"] for r in got] == list(count)
    assert [r["bin_start"] for r in got] == pytest.approx(list(edges[:-1]))
    assert got[-1]["bin_end"] == edges[-1]


def test_correlation_pairs_and_constant(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, None), (3.0, 5.0), (4.0, 4.0)], "a double, b double")
    assert stats.pair_corr(df, "a", "b").first()["corr"] == pytest.approx(0.838628, abs=1e-6)
    const = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "a double, b double")
    assert stats.pair_corr(const, "a", "b").first()["corr"] is None


def test_correlation_matrix_is_symmetric(spark):
    df = spark.createDataFrame([(float(i), float(i * i % 7), 1.0) for i in range(20)], "a double, b double, c double")
    m = {(r["col_a"], r["col_b"]): r["corr"] for r in stats.correlation_matrix(df).collect()}
    assert len(m) == 9
    assert m[("a", "b")] == m[("b", "a")]
    assert m[("a", "a")] == pytest.approx(1.0)
    assert m[("c", "a")] is None


def test_histogram_closed_top(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "x double")
    got = [r["count"] for r in stats.histogram(df, "x", bins=4).orderBy("bin").collect()]
    assert got == [1, 0, 1, 1]


def test_value_counts_drop_null(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",)], "k string")
    assert [tuple(r) for r in stats.value_counts(df, "k").collect()] == [("a", 2)]


def test_group_keys_drop_null(spark):
    df = spark.createDataFrame([("x", 1), (None, 0), ("x", 0)], "region string, churn int")
    rows = stats.region_churn(df).collect()
    assert [(r["region"], r["churn_rate"]) for r in rows] == [("x", 50.0)]


def test_churn_distribution_absent_class(spark):
    df = spark.createDataFrame([(0,), (0,)], "churn int")
    assert sorted(tuple(r) for r in stats.churn_distribution(df).collect()) == [(0, 2), (1, 0)]


def test_confusion_and_report_totals(spark):
    rows = [(1, 1)] * 5 + [(1, 0)] * 2 + [(0, 0)] * 3 + [(0, 1)]
    df = spark.createDataFrame(rows, "y int, p int")
    cm = model.confusion_matrix(df, "y", "p").collect()
    assert sum(r["count"] for r in cm) == len(rows)
    rep = {r["class"]: r for r in model.classification_report(df, "y", "p").collect()}
    assert rep["1"]["precision"] == pytest.approx(5 / 6)
    assert rep["1"]["recall"] == pytest.approx(5 / 7)
    assert rep["0"]["support"] + rep["1"]["support"] == len(rows)
    assert rep["accuracy"]["f1_score"] == pytest.approx(8 / 11)
    assert model.accuracy(df, "y", "p").first()["accuracy"] == pytest.approx(8 / 11)


def test_report_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    rep = {r["class"]: r for r in model.classification_report(df, "y", "p").collect()}
    assert rep["1"]["precision"] == 0.0 and rep["1"]["f1_score"] == 0.0


def test_box_summary(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([("g", v) for v in vals], "seg string, x double")
    r = stats.box_summary(df, "seg", "x").first()
    assert (r["q1"], r["median"], r["q3"]) == (2.0, 3.0, 4.0)
    assert (r["lower_whisker"], r["upper_whisker"], r["outliers"], r["n"]) == (1.0, 4.0, 1, 5)


def test_quality_checks_flags(spark):
    import datetime as dt
    rows = [(1, 2_000_000, 3, 0, None, dt.datetime(2024, 1, 1)), (2, 40_000_000, 0, 1, None, None)]
    df = spark.createDataFrame(rows, "transaction_id int, sales_amount long, modification_count int, "
                                     "transaction_canceled int, cancellation_date timestamp_ntz, "
                                     "transaction_date timestamp_ntz")
    got = {r["check_name"]: r["passed"] for r in
           stats.quality_checks(df, 2, (1_000_000, 30_000_000), (0.5, 0.7), (0.0, 1.0),
                                allow_null=["cancellation_date"]).collect()}
    assert got == {"row_count": True, "amount_min": True, "amount_max": False, "mod_cancel_corr": False,
                   "cancel_rate": True, "no_missing": False}


@pytest.mark.parametrize("low,step", [(1.0e9, 1.0), (1.7e9, 0.25), (-1.0e9, 1.0), (1.0, 2.0 ** -52)])
def test_quantiles_of_a_narrow_band(spark, low, step):
    """All values lie in a few logarithmic bins; they are told apart by stretches of a bin."""
    n = 200_000
    df = spark.range(n).select((F.lit(low) + F.col("id") * F.lit(step)).alias("v"), (F.col("id") % 2).alias("g"))
    values = low + np.arange(n) * step
    probs = [0.0, 0.013, 0.5, 0.77, 1.0]
    got = {(r["g"], r["p"]): r["value"] for r in quantiles(df, "v", probs, by=["g"], narrow=True).collect()}
    for g in (0, 1):
        for p in probs:
            part = values[g::2]
            at = p * (len(part) - 1)
            j = int(np.floor(at))
            wanted = part[j] + (at - j) * (part[min(j + 1, len(part) - 1)] - part[j])
            assert got[g, p] == pytest.approx(wanted, rel=0, abs=step * 1e-3 + abs(wanted) * 2e-16)


def test_no_task_sorts_a_narrow_band(spark):
    """Of 10 million ids near 10^9 in one group at most 1 % are sorted by one window."""
    from churnwise.operators import quantiles as q
    n = 10_000_000
    df = spark.range(0, n, 1, 8).select((F.col("id") + 10 ** 9).cast("double").alias("_v"), F.lit(1).alias("g"))
    vals = df.withColumn("_bin", q.value_bin(F.col("_v")))
    targets = q._targets(vals, ["g"], [0.5], False)
    assert vals.select("_bin").distinct().count() < n / 100
    carried = [c for c in targets.columns if c not in ("g", "_bin")]
    counts = vals.join(F.broadcast(targets), ["g", "_bin"]).groupBy("g", "_bin", *carried, "_v").agg(
        F.count(F.lit(1)).alias("_k"))
    assert min(q.LINEAR_BINS, counts.count()) < n / 100  # stretches
    assert q._in_stretch(counts, ["g"]).count() < n / 100
    assert q.quantiles(df, "_v", [0.5], by=["g"], narrow=True).first()["value"] == 10 ** 9 + (n - 1) / 2


def test_many_groups_without_broadcast(spark):
    df = spark.range(120_000).select((F.col("id") % 40_000).alias("g"), F.col("id").cast("double").alias("x"))
    out = stats.box_summary(df, "g", "x", broadcast=False)
    assert out.count() == 40_000
    row = out.where("g = 7").first()
    assert (row["q1"], row["median"], row["n"]) == (20_007.0, 40_007.0, 3)
    with pytest.raises(Exception, match="broadcast=False"):
        stats.box_summary(df, "g", "x").collect()
