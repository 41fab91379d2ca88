"""Lookups, lists and top-k.

Top-k is ``orderBy(...).limit(n)``, which Spark plans as TakeOrderedAndProject:
each task keeps its n best rows and only n x tasks rows reach the final merge,
so no full sort and no shuffle of the data.  Every order carries
``customer_id`` as the last key so ties resolve the same way on any layout.
Point lookups are equality filters that reach the Parquet scan as pushed
filters (row-group skipping by min/max statistics).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnwise.functions.columns import above, available, round_even


# B4 / F11 ---------------------------------------------------------------------
def customer_detail(df: DataFrame, customer_id, key: str = "customer_id",
                    cols: Sequence[str] | None = None) -> DataFrame:
    out = df.where(F.col(key) == F.lit(customer_id))
    return out.select(*available(out, cols)) if cols is not None else out


# B5 ---------------------------------------------------------------------------
def cancel_scatter(tx: DataFrame) -> DataFrame:
    """Both scatter series in one projection: modifications and rating, with the
    series named by the cancel flag."""
    return tx.select(
        "transaction_id", "modification_count", "service_rating",
        F.when(F.col("transaction_canceled") == 1, F.lit("canceled")).otherwise(F.lit("kept")).alias("series"))


# E1 ---------------------------------------------------------------------------
TOP_RISK_COLUMNS = ("customer_id", "age", "total_spent", "region", "churn_probability")


def top_risk(df: DataFrame, n: int = 10, prob_col: str = "churn_probability",
             key: str = "customer_id") -> DataFrame:
    """The n highest probabilities with the display columns that exist and the
    probability as percent text (half-even to one digit)."""
    top = df.orderBy(F.desc(prob_col), F.asc(key)).limit(n)
    cols = [c for c in available(top, TOP_RISK_COLUMNS) if c != prob_col]
    pct = F.format_string("%s%%", round_even(F.col(prob_col) * 100, 1).cast("string"))
    return top.select(*cols, F.col(prob_col).alias("churn_probability"), pct.alias("churn_percent"))


# E2 ---------------------------------------------------------------------------
HIGH_RISK_COLUMNS = ("customer_id", "region", "subscription_type", "total_orders", "last_order_days",
                     "risk_score", "churn_probability")


def high_risk_list(df: DataFrame, min_score: float = 70.0, n: int = 50, score_col: str = "risk_score",
                   key: str = "customer_id", cols: Sequence[str] = HIGH_RISK_COLUMNS) -> DataFrame:
    """Rows with score >= min_score, highest first, at most n."""
    out = (df.where(above(score_col, min_score, inclusive=True))
           .orderBy(F.desc(score_col), F.asc(key)).limit(n))
    return out.select(*available(out, cols))


# E4 ---------------------------------------------------------------------------
def preview(df: DataFrame, n: int = 10, key: str = "customer_id") -> DataFrame:
    """The first n rows by key (made deterministic)."""
    return df.orderBy(key).limit(n)


# E5 ---------------------------------------------------------------------------
def customer_history(tx: DataFrame, customer_id, key: str = "customer_id",
                     date_col: str = "transaction_date", id_col: str = "transaction_id") -> DataFrame:
    """Transactions of one customer, newest first."""
    return tx.where(F.col(key) == F.lit(customer_id)).orderBy(F.desc(date_col), F.asc(id_col))


def customer_activity(tx: DataFrame, customer_id, key: str = "customer_id") -> DataFrame:
    """Transactions, sales, cancellations and most modifications of one customer per month."""
    mine = tx.where(F.col(key) == F.lit(customer_id))
    return mine.groupBy(F.date_trunc("month", "transaction_date").alias("month")).agg(
        F.count(F.lit(1)).alias("transactions"), F.round(F.sum("sales_amount"), 2).alias("sales"),
        F.sum("transaction_canceled").alias("canceled"), F.max("modification_count").alias("most_modifications"))
