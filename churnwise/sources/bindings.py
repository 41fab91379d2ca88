"""Bind the driver's TPC-H-style Parquet tables to the churn tables.

``tx``   one row per order (orders left join lineitem rolled up by order);
``tx180`` the orders of the last 180 days before the as-of date;
``cu``   one row per customer in the dashboard form.

The as-of date is ``max(o_orderdate)``, evaluated once as a scalar subquery so
the derived predicate is a plain comparison in the scan's filter.
Every expression here has a twin in ``churnwise.plans.sql`` for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnwise.functions.columns import clip, whole_days

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def as_of(spark: SparkSession, sf_dir: str) -> Column:
    """The as-of timestamp (S18) as a scalar subquery column."""
    return table(spark, sf_dir, "orders").select(F.max("o_orderdate")).scalar()


def order_lines(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """lineitem rolled up by order (``L``); map-side combined before the shuffle.

    With ``orders`` only the lines of these orders are grouped: the range of their keys reaches the
    scan, where row groups outside it are skipped, and a semi-join leaves the lines of their keys.
    """
    li = table(spark, sf_dir, "lineitem")
    if orders is not None:
        ends = [orders.select(f("o_orderkey")).scalar() for f in (F.min, F.max)]
        li = li.where(F.col("l_orderkey").between(*ends)).join(
            orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    return li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.min("l_suppkey").alias("seller_id"),
        F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("payment"),
        F.avg("l_discount").alias("avg_discount"),
        F.bool_and(F.col("l_returnflag") == F.lit("R")).alias("all_returned"),
        F.max("l_shipdate").alias("last_ship"),
    )


def transactions(spark: SparkSession, sf_dir: str, recent_days: int | None = None, customer=None) -> DataFrame:
    """``tx`` (all orders) or ``tx180`` (``recent_days=180``), of one ``customer`` if given."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    if recent_days is not None:
        cutoff = as_of(spark, sf_dir) - F.make_dt_interval(F.lit(recent_days))
        orders = orders.where(F.col("o_orderdate") > cutoff)
    if customer is not None:
        orders = orders.where(F.col("o_custkey") == F.lit(customer))
    lines = order_lines(spark, sf_dir, orders if customer is not None else None)
    j = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
    canceled = F.coalesce(F.col("all_returned"), F.lit(False))
    return j.select(
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("seller_id"),
        F.col("o_orderdate").alias("transaction_date"),
        F.col("o_totalprice").alias("sales_amount"),
        F.col("o_orderpriority").alias("service_category"),
        # the domain of the count is 0..10 (its declared range), so larger line counts are clipped to it
        clip(F.coalesce(F.col("n_lines"), F.lit(0)), 0, 10).cast("int").alias("modification_count"),
        F.coalesce(F.col("payment"), F.lit(0.0)).alias("additional_payment"),
        F.round(F.coalesce(F.lit(5.0) - F.lit(40.0) * F.col("avg_discount"), F.lit(5.0)), 6)
        .alias("service_rating"),
        canceled.cast("int").alias("transaction_canceled"),
        F.when(canceled, F.col("last_ship")).alias("cancellation_date"),
    )


def average_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``avg_order_value`` of every customer with orders, from the orders alone."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("avg_order_value"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cu`` without the churn label (see ``rules.churn_label``)."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    o = (table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("join_date"),
        F.max("o_orderdate").alias("last_order"),
        F.sum("o_totalprice").alias("spent"),
        F.count(F.lit(1)).alias("orders"),
        F.avg("o_totalprice").alias("avg_order_value")))
    e = (table(spark, sf_dir, "events").where(F.col("event_type") == F.lit("error"))
         .groupBy("user_id").agg(F.count(F.lit(1)).alias("tickets")))
    seg = F.col("c_mktsegment")
    base = (c.join(n, c.c_nationkey == n.n_nationkey)
            .join(r, F.col("n_regionkey") == r.r_regionkey)
            .join(o, c.c_custkey == o.o_custkey, "left")
            .join(e, c.c_custkey == e.user_id, "left"))
    return base.select(
        F.col("c_custkey").alias("customer_id"),
        (F.lit(20) + F.col("c_custkey") % F.lit(41)).cast("int").alias("age"),
        F.col("r_name").alias("region"),
        F.when(F.col("c_acctbal") < 0, F.lit("company")).otherwise(F.lit("person")).alias("customer_type"),
        F.when(seg == "BUILDING", F.lit("Premium")).when(seg == "MACHINERY", F.lit("Enterprise"))
        .when(seg == "FURNITURE", F.lit(None).cast("string")).otherwise(F.lit("Basic"))
        .alias("subscription_type"),
        F.col("join_date"),
        F.coalesce(F.col("spent"), F.lit(0.0)).alias("total_spent"),
        F.coalesce(F.col("orders"), F.lit(0)).alias("total_orders"),
        F.col("avg_order_value"),
        whole_days(F.col("last_order"), as_of(spark, sf_dir)).alias("last_order_days"),
        F.coalesce(F.col("tickets"), F.lit(0)).alias("support_tickets"),
    )
