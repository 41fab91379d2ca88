"""Business rules and lists on hand rows."""

import datetime as dt

import pytest

from churnwise.operators import lists, rules


def _tx(spark, rows):
    return spark.createDataFrame(rows, "customer_id string, transaction_date timestamp_ntz, sales_amount double, "
                                       "modification_count int, additional_payment double, service_rating double, "
                                       "transaction_canceled int")


def test_rule_risk_order_of_operations(spark):
    d0, d1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 6, 1)
    tx = _tx(spark, [("A", d0, 1.0, 5, 10.0, 4.0, 1), ("A", d1, 1.0, 5, 0.0, 4.0, 0)])
    cust = spark.createDataFrame([("A", "premium"), ("B", "regular")], "customer_id string, customer_segment string")
    got = {r["customer_id"]: (r["churn_probability"], r["risk_level"]) for r in rules.rule_risk(cust, tx).collect()}
    assert got["A"] == (pytest.approx(0.46), "mid")
    assert got["B"] == (0.0, None)


def test_rule_risk_clips(spark):
    d0 = dt.datetime(2024, 1, 1)
    tx = _tx(spark, [("A", d0, 1.0, 9, 0.0, 1.0, 1)])
    cust = spark.createDataFrame([("A", "regular")], "customer_id string, customer_segment string")
    r = rules.rule_risk(cust, tx).first()
    assert (r["churn_probability"], r["risk_level"]) == (1.0, "high")


def test_churn_label(spark):
    rows = [(1, 100, 6, 2, 10.0), (2, 10, 0, 9, 50.0), (3, 10, 0, 9, 60.0), (4, 10, 0, 9, None)]
    df = spark.createDataFrame(rows, "customer_id int, last_order_days int, support_tickets int, total_orders int, "
                                     "avg_order_value double")
    got = {r["customer_id"]: (r["churn_probability"], r["churn"]) for r in rules.churn_label(df).collect()}
    assert got[1] == (pytest.approx(0.85), 1)
    assert got[2] == (0.0, 0)
    assert got[4] == (0.0, 0)


def test_cancel_propensity_bounds(spark):
    d0 = dt.datetime(2024, 1, 1)
    tx = _tx(spark, [("A", d0, 1e6, 10, 0.0, 1.0, 0), ("B", d0, 3e7, 0, 5.0, 5.0, 0)])
    vals = [r["cancel_propensity"] for r in rules.cancel_propensity(tx).collect()]
    assert all(0.0 <= v <= 0.15 for v in vals)


def test_top_risk_ties_by_id(spark):
    df = spark.createDataFrame([("C", 0.9), ("A", 0.9), ("B", 0.95), ("D", 0.1)],
                               "customer_id string, churn_probability double")
    got = [(r["customer_id"], r["churn_percent"]) for r in lists.top_risk(df, n=3).collect()]
    assert got == [("B", "95.0%"), ("A", "90.0%"), ("C", "90.0%")]


def test_high_risk_list_inclusive(spark):
    df = spark.createDataFrame([("A", 70.0), ("B", 69.99), ("C", 90.0)], "customer_id string, risk_score double")
    assert [r["customer_id"] for r in lists.high_risk_list(df, 70.0, 10).collect()] == ["C", "A"]


def test_history_newest_first(spark):
    d0, d1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    df = spark.createDataFrame([("t1", "A", d0), ("t2", "A", d1), ("t3", "B", d1)],
                               "transaction_id string, customer_id string, transaction_date timestamp_ntz")
    assert [r[0] for r in lists.customer_history(df, "A").collect()] == ["t2", "t1"]


def test_gauge(spark):
    df = spark.createDataFrame([("A", 95.0), ("B", 30.0)], "customer_id string, risk_score double")
    got = {r["customer_id"]: (r["gauge_label"], r["delta"], r["alert"]) for r in rules.risk_gauge(df).collect()}
    assert got == {"A": ("high", 45.0, True), "B": ("medium", -20.0, False)}
