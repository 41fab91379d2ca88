"""Customer rollups, master-table joins and purchase segments.

All rollups are hash aggregates keyed by ``customer_id``: Spark combines them
map-side, so a customer owning a third of the transactions adds one partial row
per map task to the shuffle, not a third of the data.  The left joins that follow
are co-partitioned with the rollup output (same key, same partitioner), so only
the customer master is exchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnwise.functions.columns import fill_zero, month, whole_days
from churnwise.operators.quantiles import quantile_row
from churnwise.schemas import SEGMENT_LABELS


# D1 ---------------------------------------------------------------------------
def customer_rollup(tx: DataFrame) -> DataFrame:
    return tx.groupBy("customer_id").agg(
        F.sum("sales_amount").alias("total_purchase_amount"),
        F.sum("modification_count").alias("total_modification_count"),
        F.sum("additional_payment").alias("total_additional_payment"),
        F.sum("transaction_canceled").alias("total_cancellations"),
        F.min("transaction_date").alias("first_transaction_date"),
        F.max("transaction_date").alias("last_transaction_date"),
        F.count(F.lit(1)).alias("transaction_count"),
    )


# D2 ---------------------------------------------------------------------------
def exact_mean(col: str, scale: int = 6):
    """Mean of values with at most ``scale`` decimals, summed as integers: the
    result does not depend on summation order (partitioning), so thresholds on
    it are reproducible.  Exact while the scaled sum stays below 2^53."""
    units = F.round(F.col(col) * F.lit(10.0 ** scale)).cast("long")
    return F.sum(units).cast("double") / F.count(units) / F.lit(10.0 ** scale)


def behaviour_rollup(tx: DataFrame, rating_digits: int | None = None) -> DataFrame:
    """Per customer behaviour.  The mean rating is the plain mean; with ``rating_digits``
    it is that of the ratings rounded to so many decimals, summed exactly (see ``exact_mean``)."""
    rating = F.avg("service_rating") if rating_digits is None else exact_mean("service_rating", rating_digits)
    g = tx.groupBy("customer_id").agg(
        F.avg("modification_count").alias("avg_modification_count"),
        F.sum("modification_count").alias("total_modification_count"),
        F.avg("additional_payment").alias("avg_additional_payment"),
        F.sum("additional_payment").alias("total_additional_payment"),
        rating.alias("avg_rating"),
        F.sum("transaction_canceled").alias("total_cancellations"),
        F.min("transaction_date").alias("first_transaction_date"),
        F.max("transaction_date").alias("last_transaction_date"),
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum("sales_amount").alias("total_sales"),
    )
    return g.withColumn("transaction_duration_days",
                        whole_days("first_transaction_date", "last_transaction_date"))


# F1 ---------------------------------------------------------------------------
def assign_segment(df: DataFrame, col: str = "total_purchase_amount",
                   probs: Sequence[float] = (0.7, 0.9), labels: Sequence[str] = SEGMENT_LABELS,
                   out: str = "customer_segment", exact: bool = True) -> DataFrame:
    """Segment by the 70 % / 90 % quantiles of ``col`` over the rows of ``df``.

    ``>=`` comparisons; a missing value falls to the first (regular) label.
    The thresholds are one row, joined by broadcast (C4), never collected.
    """
    names = [f"_q{i}" for i in range(len(probs))]
    q = quantile_row(df, col, probs, names, exact=exact)
    x = F.col(col)
    seg = F.lit(labels[0])
    for name, label in zip(names, labels[1:]):
        seg = F.when(F.coalesce(x >= F.col(name), F.lit(False)), F.lit(label)).otherwise(seg)
    return df.crossJoin(F.broadcast(q)).withColumn(out, seg).drop(*names)


# D3 / C1 / B9 -----------------------------------------------------------------
def customer_table(customers: DataFrame, tx: DataFrame, exact: bool = True) -> DataFrame:
    """Customer master with rollups and segments; customers without transactions
    get zero totals and the regular segment.

    ``customers`` needs ``customer_id, age, region`` and a registration date
    (``registration_date`` or ``join_date``).
    """
    stats = assign_segment(customer_rollup(tx), exact=exact)
    reg = "registration_date" if "registration_date" in customers.columns else "join_date"
    master = customers.select("customer_id", "age", "region", F.col(reg).alias("registration_date"))
    j = master.join(stats, "customer_id", "left")
    totals = ("total_purchase_amount", "total_modification_count", "total_additional_payment")
    out = j.select(
        "customer_id", "age", "region", F.col(totals[0]).cast("double"),
        F.coalesce(F.col("customer_segment"), F.lit(SEGMENT_LABELS[0])).alias("customer_segment"),
        "registration_date", F.col(totals[1]).cast("double"), F.col(totals[2]).cast("double"))
    return fill_zero(out, totals)


# C3 ---------------------------------------------------------------------------
def with_predictions(customers: DataFrame, predictions: DataFrame) -> DataFrame:
    return customers.join(predictions, "customer_id", "inner")


# C4 ---------------------------------------------------------------------------
def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a one-row aggregate (quantile, mean, deviation) to every row.

    The right side is an aggregate without grouping keys, i.e. exactly one row,
    so broadcasting it is safe at any scale.
    """
    return df.crossJoin(F.broadcast(one_row))


# D10 by customer --------------------------------------------------------------
def monthly_amounts(tx: DataFrame, key: str = "customer_id", date: str = "transaction_date",
                    amount: str = "sales_amount") -> DataFrame:
    """One row per customer and one column ``yyyy-MM`` per month that occurs: the customer's amount of the month,
    null where they bought nothing.  The months (one value per calendar month) are read first."""
    rows = tx.where(F.col(key).isNotNull() & F.col(date).isNotNull()).select(
        key, month(F.col(date)).alias("_month"), F.col(amount).alias("_amount"))
    months = rows.agg(F.sort_array(F.collect_set("_month"))).first()[0]
    return rows.groupBy(key).pivot("_month", months).agg(F.sum("_amount"))
