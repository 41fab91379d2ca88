"""The newest row per customer: late, repeated, equal and missing times."""

import datetime as dt

from churnwise.streaming.scoring import latest_scores

SCHEMA = "customer_id long, updated_at timestamp_ntz, churn_probability double, row string"


def day(n):
    return dt.datetime(2024, 1, n)


def test_newest_row_wins(spark):
    rows = [(1, day(1), 0.1, "old"), (1, day(3), 0.3, "new"), (1, day(2), 0.2, "late"), (1, day(3), 0.3, "new"),
            (2, None, 0.4, "no time"), (2, day(1), None, "null score"), (3, None, 0.5, None), (None, day(9), 1.0, "no key")]
    for parts in (1, 5):
        got = latest_scores(spark.createDataFrame(rows, SCHEMA).repartition(parts))
        assert got.columns == ["customer_id", "updated_at", "churn_probability", "row"]
        assert sorted(tuple(r) for r in got.collect()) == [
            (1, day(3), 0.3, "new"), (2, day(1), None, "null score"), (3, None, 0.5, None)]


def test_equal_times_choose_alike(spark):
    rows = [(1, day(1), float(i), str(i)) for i in range(50)]
    picked = {tuple(latest_scores(spark.createDataFrame(r, SCHEMA).repartition(p)).first())
              for r, p in ((rows, 1), (rows[::-1], 4), (rows[25:] + rows, 7))}
    assert len(picked) == 1


def test_empty_and_partial_aggregation(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert latest_scores(empty).count() == 0
    plan = latest_scores(empty.repartition(3))._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan
