"""Scalar functions and predicates on hand rows (FIXTURES section 3)."""

import datetime as dt

from pyspark.sql import functions as F

from churnwise.functions import columns as C
from churnwise.schemas import AGE_EDGES, AGE_LABELS, GAUGE_EDGES, GAUGE_LABELS, RISK_EDGES, RISK_LABELS


def _one(spark, values, expr, typ="double"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(expr).collect()]


def test_age_cut_right_closed(spark):
    got = _one(spark, [0, 20, 21, 30, 50, 51, 100, 101, None], C.cut("x", AGE_EDGES, AGE_LABELS), "int")
    assert got == [None, "10s", "20s", "20s", "40s", "50s+", "50s+", None, None]


def test_risk_cut_right_closed(spark):
    got = _one(spark, [0.0, 0.3, 0.31, 0.7, 0.71, 1.0], C.cut("x", RISK_EDGES, RISK_LABELS))
    assert got == [None, "low", "mid", "mid", "high", "high"]
    got = _one(spark, [0.0], C.cut("x", RISK_EDGES, RISK_LABELS, include_lowest=True))
    assert got == ["low"]


def test_band_left_closed(spark):
    got = _one(spark, [29.9, 30.0, 69.9, 70.0, None], C.band("x", GAUGE_EDGES, GAUGE_LABELS))
    assert got == ["low", "medium", "medium", "high", None]


def test_round_half_even(spark):
    assert _one(spark, [0.125], C.round_even("x", 2)) == [0.12]
    assert _one(spark, [2.5], C.round_even("x", 0)) == [2.0]


def test_whole_days(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 20), dt.datetime(2024, 1, 3, 10))],
                               "a timestamp_ntz, b timestamp_ntz")
    assert df.select(C.whole_days("a", "b")).first()[0] == 1


def test_encode_default_and_null(spark):
    got = _one(spark, ["Basic", "Enterprise", "Gold", None], C.encode("x", {"Basic": 0, "Enterprise": 2}, 5),
               "string")
    assert got == [0, 2, 5, 5]


def test_null_comparison_is_false(spark):
    assert _one(spark, [None, 3.0], C.flag(F.col("x") > 1)) == [0, 1]


def test_clip_and_text(spark):
    assert _one(spark, [-1.0, 0.5, 2.0, None], C.clip("x", 0.0, 1.0)) == [0.0, 0.5, 1.0, None]
    assert _one(spark, [0.4567], C.percent_text("x")) == ["45.7%"]
    assert _one(spark, [1234567.0], C.thousands("x")) == ["1,234,567"]
    assert _one(spark, [7], C.padded_key("x"), "int") == ["CUST_00007"]
    assert _one(spark, ["churn_probability"], C.title_case("x"), "string") == ["Churn Probability"]


def test_select_available_and_numeric(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "customer_id int, s string, v double")
    assert C.select_available(df, ["v", "missing", "s"]).columns == ["v", "s"]
    assert C.numeric_columns(df) == ["v"]
