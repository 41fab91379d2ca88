"""Registered queries: one Spark plan per operator of the inventory, each over
the whole bound tables, with its DuckDB twin where SQL can express it.

Doubles are rounded at the end on both sides (6 digits; money sums to 2 and
payment sums to 4 digits, which are exact on their decimal grid) so that
summation order cannot change the compared values.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnwise.functions.columns import (as_of_stamp, flag, high_risk, numeric_columns, padded_key, percent_text,
                                         select_available, thousands, title_case, to_class, upper_name)
from churnwise.operators import lists, model, rollups, rules, stats
from churnwise.operators.quantiles import quantiles
from churnwise.plans.sql import with_ctes
from churnwise.schemas import (AMOUNT_RANGE, BOUND_TRANSACTIONS, CANCEL_RATE_RANGE, DASHBOARD_FEATURES,
                               EXPECTED_TRANSACTION_ROWS, MOD_CANCEL_CORR_RANGE, SEGMENT_LABELS, ChurnLabelParams,
                               TreeParams)
from churnwise.session import FittedModels, finished, kept, scratch_path
from churnwise.sources import bindings

LABEL_THRESHOLD = 0.4  # FIXTURES: the default 0.5 leaves few positives


# ---------------------------------------------------------------------------
# Bound inputs
# ---------------------------------------------------------------------------
def tx(spark, d):
    return bindings.transactions(spark, d)


def tx180(spark, d):
    return bindings.transactions(spark, d, recent_days=180)


def cu(spark, d):
    # the quantile of the label rule reads the order averages alone
    return rules.churn_label(bindings.customers(spark, d), ChurnLabelParams(threshold=LABEL_THRESHOLD),
                             values=bindings.average_orders(spark, d))


def ct(spark, d):
    # the customer master alone: the churn label is not needed for the table
    return rollups.customer_table(bindings.customers(spark, d), tx(spark, d))


RATING_DIGITS = 6  # FIXTURES: some mean ratings of the bound data fall exactly on the threshold


def preds(spark, d):
    return rules.rule_risk(ct(spark, d), tx(spark, d), rating_digits=RATING_DIGITS)


def rounded(df: DataFrame, digits: int = 6, **special) -> DataFrame:
    """Round every double column (``special`` gives per-column digits; None
    keeps a column that both engines compute exactly as it is)."""
    def one(f):
        if not isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.col(f.name)
        d = special.get(f.name, digits)
        return F.col(f.name) if d is None else F.round(F.col(f.name), d).alias(f.name)
    return df.select(*[one(f) for f in df.schema.fields])


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    headline: bool = False


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, headline: bool = False):
    def deco(fn):
        REGISTRY[name] = Query(fn, sql, headline)
        return fn
    return deco


# ---------------------------------------------------------------------------
# The flagship
# ---------------------------------------------------------------------------
@register("segment_stats", with_ctes(["ct"], """
SELECT customer_segment, round(avg(total_purchase_amount), 6) AS mean_purchase,
  count(total_purchase_amount) AS customers, round(sum(total_purchase_amount), 2) AS total_purchase,
  round(avg(total_modification_count), 6) AS mean_modifications, round(avg(age), 6) AS mean_age
FROM ct WHERE customer_segment IS NOT NULL GROUP BY customer_segment"""), headline=True)
def q_segment_stats(spark, d):
    return rounded(stats.segment_stats(ct(spark, d)), total_purchase=2)


@register("customer_table", with_ctes(["ct"], """
SELECT customer_id, age, region, round(total_purchase_amount, 2) AS total_purchase_amount,
  customer_segment, registration_date, round(total_modification_count, 6) AS total_modification_count,
  round(total_additional_payment, 4) AS total_additional_payment FROM ct"""))
def q_customer_table(spark, d):
    return rounded(ct(spark, d), total_purchase_amount=2, total_additional_payment=4)


@register("customer_table_recent", with_ctes(["ct180"], """
SELECT customer_id, age, region, round(total_purchase_amount, 2) AS total_purchase_amount,
  customer_segment, registration_date, round(total_modification_count, 6) AS total_modification_count,
  round(total_additional_payment, 4) AS total_additional_payment FROM ct180"""))
def q_customer_table_recent(spark, d):
    """The customer table over the transactions of the last 180 days: half the customers have none."""
    return rounded(rollups.customer_table(bindings.customers(spark, d), tx180(spark, d)),
                   total_purchase_amount=2, total_additional_payment=4)


@register("customer_rollup", with_ctes(["tx"], """
SELECT customer_id, round(sum(sales_amount), 2) AS total_purchase_amount,
  CAST(sum(modification_count) AS BIGINT) AS total_modification_count,
  round(sum(additional_payment), 4) AS total_additional_payment,
  CAST(sum(transaction_canceled) AS BIGINT) AS total_cancellations,
  min(transaction_date) AS first_transaction_date, max(transaction_date) AS last_transaction_date,
  count(*) AS transaction_count
FROM tx GROUP BY customer_id"""), headline=True)
def q_customer_rollup(spark, d):
    return rounded(rollups.customer_rollup(tx(spark, d)), total_purchase_amount=2, total_additional_payment=4)


@register("behaviour_rollup", with_ctes(["B"], """
SELECT customer_id, round(avg_modification_count, 6) AS avg_modification_count, total_modification_count,
  round(avg_additional_payment, 8) AS avg_additional_payment,
  round(total_additional_payment, 4) AS total_additional_payment, avg_rating,
  total_cancellations, first_transaction_date, last_transaction_date, transaction_count,
  round(total_sales, 2) AS total_sales, transaction_duration_days FROM B"""))
def q_behaviour_rollup(spark, d):
    return rounded(rollups.behaviour_rollup(tx(spark, d), RATING_DIGITS).withColumn(
        "total_modification_count", F.col("total_modification_count").cast("long")),
        total_additional_payment=4, total_sales=2, avg_rating=None, avg_additional_payment=8)


@register("purchase_segments", with_ctes(["tx"], """
R2 AS (SELECT customer_id, sum(sales_amount) AS total_purchase_amount FROM tx GROUP BY customer_id),
Q2 AS (SELECT quantile_cont(total_purchase_amount, 0.7) AS q70,
              quantile_cont(total_purchase_amount, 0.9) AS q90 FROM R2)
SELECT customer_id, round(total_purchase_amount, 2) AS total_purchase_amount,
  CASE WHEN coalesce(total_purchase_amount >= q90, false) THEN 'VIP'
       WHEN coalesce(total_purchase_amount >= q70, false) THEN 'premium' ELSE 'regular' END AS customer_segment
FROM R2 CROSS JOIN Q2"""))
def q_purchase_segments(spark, d):
    r = tx(spark, d).groupBy("customer_id").agg(F.sum("sales_amount").alias("total_purchase_amount"))
    return rounded(rollups.assign_segment(r), total_purchase_amount=2)


@register("with_predictions", with_ctes(["ct", "preds"], """
SELECT ct.customer_id, ct.customer_segment, preds.churn_probability, preds.risk_level
FROM ct JOIN preds ON ct.customer_id = preds.customer_id"""))
def q_with_predictions(spark, d):
    j = rollups.with_predictions(ct(spark, d), preds(spark, d))
    return rounded(j.select("customer_id", "customer_segment", "churn_probability", "risk_level"))


# ---------------------------------------------------------------------------
# Rules F2-F4, F15
# ---------------------------------------------------------------------------
@register("rule_risk", with_ctes(["preds"], "SELECT customer_id, churn_probability, risk_level FROM preds"),
          headline=True)
def q_rule_risk(spark, d):
    return rounded(preds(spark, d))


@register("risk_level_counts", with_ctes(["preds"], """
SELECT risk_level, count(*) AS count FROM preds WHERE risk_level IS NOT NULL GROUP BY risk_level"""))
def q_risk_level_counts(spark, d):
    return stats.value_counts(preds(spark, d), "risk_level")


@register("customers", with_ctes(["cu"], """
SELECT customer_id, age, region, customer_type, subscription_type, join_date,
  round(total_spent, 2) AS total_spent, total_orders, round(avg_order_value, 6) AS avg_order_value,
  last_order_days, support_tickets, round(churn_probability, 6) AS churn_probability, churn FROM cu"""),
          headline=True)
def q_customers(spark, d):
    return rounded(cu(spark, d), total_spent=2)


@register("cancel_propensity", with_ctes(["tx"], """
M AS (SELECT avg(sales_amount) AS mu, stddev_samp(sales_amount) AS sd FROM tx)
SELECT transaction_id, customer_id, round(least(greatest(
    0.013::DOUBLE
    + modification_count / 10.0::DOUBLE * 0.6::DOUBLE * 0.05::DOUBLE
    + CAST(coalesce(additional_payment = 0, false) AS INTEGER) * 0.5::DOUBLE * 0.03::DOUBLE
    + (5.0::DOUBLE - service_rating) / 4.0::DOUBLE * 0.55::DOUBLE * 0.04::DOUBLE
    + (-((sales_amount - mu) / nullif(sd, 0))) * 0.2::DOUBLE * 0.01::DOUBLE,
  0.0::DOUBLE), 0.15::DOUBLE), 6) AS cancel_propensity
FROM tx CROSS JOIN M"""))
def q_cancel_propensity(spark, d):
    return rounded(rules.cancel_propensity(tx(spark, d)).select(
        "transaction_id", "customer_id", "cancel_propensity"))


@register("risk_gauge", with_ctes(["preds"], """
S AS (SELECT customer_id, round_even(churn_probability * 100, 2) AS risk_score FROM preds)
SELECT customer_id, round(risk_score, 6) AS risk_score,
  CASE WHEN risk_score IS NULL THEN NULL WHEN risk_score < 30 THEN 'low'
       WHEN risk_score < 70 THEN 'medium' ELSE 'high' END AS gauge_label,
  round(risk_score - 50.0::DOUBLE, 6) AS delta, coalesce(risk_score >= 90.0, false) AS alert
FROM S"""))
def q_risk_gauge(spark, d):
    p = preds(spark, d).withColumn("risk_score", F.bround(F.col("churn_probability") * 100, 2))
    return rounded(rules.risk_gauge(p))


# ---------------------------------------------------------------------------
# Aggregations D5-D23
# ---------------------------------------------------------------------------
@register("segment_churn", with_ctes(["cu"], """
SELECT subscription_type, round(round_even(avg(CAST(churn AS DOUBLE)) * 100, 2), 6) AS churn_rate,
  count(churn) AS customers
FROM cu WHERE subscription_type IS NOT NULL GROUP BY subscription_type"""))
def q_segment_churn(spark, d):
    return rounded(stats.segment_churn(cu(spark, d)))


@register("region_churn", with_ctes(["cu"], """
SELECT region, round(avg(CAST(churn AS DOUBLE)) * 100, 6) AS churn_rate
FROM cu WHERE region IS NOT NULL GROUP BY region"""))
def q_region_churn(spark, d):
    return rounded(stats.region_churn(cu(spark, d)))


@register("age_group_churn", with_ctes(["cu"], """
G AS (SELECT CASE WHEN age > 0 AND age <= 20 THEN '10s' WHEN age > 20 AND age <= 30 THEN '20s'
    WHEN age > 30 AND age <= 40 THEN '30s' WHEN age > 40 AND age <= 50 THEN '40s'
    WHEN age > 50 AND age <= 100 THEN '50s+' END AS age_group, churn FROM cu)
SELECT age_group, round(avg(CAST(churn AS DOUBLE)) * 100, 6) AS churn_rate
FROM G WHERE age_group IS NOT NULL GROUP BY age_group"""))
def q_age_group_churn(spark, d):
    return rounded(stats.age_group_churn(cu(spark, d)))


@register("monthly_churn", with_ctes(["cu"], """
G AS (SELECT strftime(join_date, '%Y-%m') AS year_month, churn FROM cu)
SELECT year_month, round(round_even(avg(CAST(churn AS DOUBLE)) * 100, 2), 6) AS churn_rate,
  count(churn) AS customers
FROM G WHERE year_month IS NOT NULL GROUP BY year_month"""))
def q_monthly_churn(spark, d):
    return rounded(stats.monthly_churn(cu(spark, d)))


@register("monthly_transactions", with_ctes(["tx"], """
G AS (SELECT strftime(transaction_date, '%Y-%m') AS year_month, transaction_canceled FROM tx)
SELECT year_month, count(*) AS transactions,
  round(avg(CAST(transaction_canceled AS DOUBLE)) * 100, 6) AS cancel_rate
FROM G WHERE year_month IS NOT NULL GROUP BY year_month"""), headline=True)
def q_monthly_transactions(spark, d):
    return rounded(stats.monthly_transactions(tx(spark, d)))


@register("category_counts", with_ctes(["tx"], """
SELECT service_category, count(*) AS count FROM tx WHERE service_category IS NOT NULL
GROUP BY service_category"""))
def q_category_counts(spark, d):
    return stats.value_counts(tx(spark, d), "service_category")


@register("churn_distribution", with_ctes(["cu"], """
C AS (SELECT count(*) FILTER (WHERE churn = 0) AS c0, count(*) FILTER (WHERE churn = 1) AS c1 FROM cu)
SELECT 0 AS class, c0 AS count FROM C UNION ALL SELECT 1 AS class, c1 AS count FROM C"""))
def q_churn_distribution(spark, d):
    return stats.churn_distribution(cu(spark, d))


@register("kpis", with_ctes(["cu"], """
SELECT round(avg(CAST(churn AS DOUBLE)) * 100, 6) AS churn_rate,
  count(*) FILTER (WHERE churn_probability > 0.7::DOUBLE) AS high_risk_customers,
  count(*) AS customers FROM cu"""), headline=True)
def q_kpis(spark, d):
    return rounded(stats.kpis(cu(spark, d)))


@register("table_shape", with_ctes(["tx"], """
SELECT 'transactions' AS table_name, count(*) AS rows, 11 AS columns FROM tx"""))
def q_table_shape(spark, d):
    return stats.table_shape(tx(spark, d), "transactions")


@register("describe_amount", with_ctes(["tx"], """
SELECT 'sales_amount' AS column_name, round(avg(sales_amount), 6) AS mean,
  round(stddev_samp(sales_amount), 6) AS std, round(min(sales_amount), 6) AS min,
  round(max(sales_amount), 6) AS max, round(quantile_cont(sales_amount, 0.5), 6) AS median FROM tx"""),
          headline=True)
def q_describe_amount(spark, d):
    return rounded(stats.describe_column(tx(spark, d), "sales_amount"))


@register("cancel_rate", with_ctes(["tx"], """
SELECT round(avg(CAST(transaction_canceled AS DOUBLE)), 6) AS event_rate,
  CAST(sum(transaction_canceled) AS BIGINT) AS events FROM tx"""))
def q_cancel_rate(spark, d):
    return rounded(stats.event_rate(tx(spark, d)))


@register("purchase_quantiles", with_ctes(["tx"], """
R2 AS (SELECT customer_id, sum(sales_amount) AS total_purchase_amount FROM tx GROUP BY customer_id)
""" + "\nUNION ALL\n".join(
    f"SELECT CAST({p} AS DOUBLE) AS p, round(quantile_cont(total_purchase_amount, {p}), 4) AS value FROM R2"
    for p in ("0.0", "0.25", "0.5", "0.7", "0.9", "1.0"))))
def q_purchase_quantiles(spark, d):
    r = tx(spark, d).groupBy("customer_id").agg(F.sum("sales_amount").alias("total_purchase_amount"))
    return rounded(quantiles(r, "total_purchase_amount", [0.0, 0.25, 0.5, 0.7, 0.9, 1.0]), value=4)


@register("amount_quantiles_by_category", with_ctes(["tx"], "\nUNION ALL\n".join(
    f"SELECT service_category, CAST({p} AS DOUBLE) AS p, round(quantile_cont(sales_amount, {p}), 4) AS value "
    f"FROM tx WHERE sales_amount IS NOT NULL AND service_category IS NOT NULL GROUP BY service_category"
    for p in ("0.1", "0.5", "0.9"))))
def q_amount_quantiles_by_category(spark, d):
    return rounded(quantiles(tx(spark, d), "sales_amount", [0.1, 0.5, 0.9], by=["service_category"]), value=4)


@register("pair_corr", with_ctes(["tx"], """
SELECT 'modification_count' AS col_a, 'transaction_canceled' AS col_b,
  round(corr(modification_count, transaction_canceled), 6) AS corr FROM tx"""))
def q_pair_corr(spark, d):
    return rounded(stats.pair_corr(tx(spark, d), "modification_count", "transaction_canceled"))


CORR_COLUMNS = ["sales_amount", "modification_count", "additional_payment", "service_rating",
                "transaction_canceled"]


def _corr_sql() -> str:
    cells = []
    for a in CORR_COLUMNS:
        for b in CORR_COLUMNS:
            cells.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
                         f"round(CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END, 6) AS corr FROM tx")
    return with_ctes(["tx"], "\nUNION ALL\n".join(cells))


@register("correlation_matrix", _corr_sql(), headline=True)
def q_correlation_matrix(spark, d):
    return rounded(stats.correlation_matrix(tx(spark, d), CORR_COLUMNS))


@register("monthly_correlation", """
WITH m AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice) AS amount FROM orders
  WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL GROUP BY ALL),
k AS (SELECT DISTINCT month FROM m),
p AS (SELECT x.month AS col_a, y.month AS col_b, corr(x.amount, y.amount) AS c, count(*) AS n
  FROM m x JOIN m y USING (o_custkey) WHERE x.amount IS NOT NULL AND y.amount IS NOT NULL GROUP BY ALL)
SELECT a.month AS col_a, b.month AS col_b, round(CASE WHEN n < 2 OR isnan(c) THEN NULL ELSE c END, 6) AS corr
FROM k a CROSS JOIN k b LEFT JOIN p ON p.col_a = a.month AND p.col_b = b.month""")
def q_monthly_correlation(spark, d):
    """D19 over a wide table: do customers who buy much in one month buy much in another?  Every month is a
    column, mostly null."""
    orders = bindings.table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    wide = rollups.monthly_amounts(orders, "o_custkey", "o_orderdate", "o_totalprice")
    return rounded(stats.correlation_matrix(wide, wide.columns[1:]))


@register("null_counts", with_ctes(["tx"], "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count, "
    f"{'true' if c == 'cancellation_date' else 'false'} AS allowed FROM tx"
    for c in ["transaction_id", "customer_id", "seller_id", "transaction_date", "sales_amount",
              "service_category", "modification_count", "additional_payment", "service_rating",
              "transaction_canceled", "cancellation_date"])))
def q_null_counts(spark, d):
    return stats.null_counts(tx(spark, d), allow=["cancellation_date"])


def _hist_sql(uses: list[str], table: str, expr: str, bins: int) -> str:
    """Counts by a range join on the bin edges."""
    return with_ctes(uses, f"""
V AS (SELECT CAST({expr} AS DOUBLE) AS x FROM {table} WHERE {expr} IS NOT NULL),
RG AS (SELECT min(x) - CASE WHEN min(x) = max(x) THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS lo,
              max(x) + CASE WHEN min(x) = max(x) THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS hi FROM V),
BN AS (SELECT range AS bin, range * ((hi - lo) / {bins}) + lo AS a,
         CASE WHEN range = {bins - 1} THEN hi ELSE (range + 1) * ((hi - lo) / {bins}) + lo END AS b
       FROM range(0, {bins}) CROSS JOIN RG WHERE lo IS NOT NULL)
SELECT bin, round(a, 6) AS bin_start, round(b, 6) AS bin_end, count(x) AS count
FROM BN LEFT JOIN V ON x >= a AND (x < b OR (bin = {bins - 1} AND x <= b)) GROUP BY bin, a, b""")


@register("amount_histogram", _hist_sql(["tx"], "tx", "sales_amount / 1e6::DOUBLE", 50), headline=True)
def q_amount_histogram(spark, d):
    return rounded(stats.histogram(tx(spark, d), "sales_amount", bins=50, divisor=1e6))


@register("modification_histogram", _hist_sql(["tx"], "tx", "modification_count", 11))
def q_modification_histogram(spark, d):
    return rounded(stats.histogram(tx(spark, d), "modification_count", bins=11))


@register("rating_histogram", _hist_sql(["tx"], "tx", "service_rating", 20))
def q_rating_histogram(spark, d):
    return rounded(stats.histogram(tx(spark, d), "service_rating", bins=20))


@register("risk_histogram", _hist_sql(["cu"], "cu", "churn_probability", 30))
def q_risk_histogram(spark, d):
    return rounded(stats.histogram(cu(spark, d), "churn_probability", bins=30))


def _box_sql(expr: str, digits: int) -> str:
    return with_ctes(["ct", "preds"], f"""
V AS (SELECT ct.customer_segment AS g, CAST({expr} AS DOUBLE) AS x FROM ct JOIN preds ON ct.customer_id = preds.customer_id
      WHERE ct.customer_segment IS NOT NULL AND {expr} IS NOT NULL),
Q AS (SELECT g, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3
      FROM V GROUP BY g),
FN AS (SELECT *, q3 - q1 AS iqr, q1 - (q3 - q1) * 1.5::DOUBLE AS lf, q3 + (q3 - q1) * 1.5::DOUBLE AS uf FROM Q)
SELECT V.g AS customer_segment, round(q1, {digits}) AS q1, round(med, {digits}) AS median,
  round(q3, {digits}) AS q3, round(iqr, {digits}) AS iqr,
  round(min(CASE WHEN x >= lf AND x <= uf THEN x END), {digits}) AS lower_whisker,
  round(max(CASE WHEN x >= lf AND x <= uf THEN x END), {digits}) AS upper_whisker,
  count(*) FILTER (WHERE NOT (x >= lf AND x <= uf)) AS outliers, count(*) AS n
FROM V JOIN FN ON V.g = FN.g GROUP BY V.g, q1, med, q3, iqr""")


def _box(spark, d, col, divisor):
    j = rules.rule_risk(ct(spark, d), tx(spark, d), rating_digits=RATING_DIGITS,
                        keep=("customer_segment", "total_purchase_amount"))
    with kept(j.select("customer_segment", col)) as (rows,):  # read in three passes
        box = rounded(stats.box_summary(rows, "customer_segment", col, divisor=divisor, order=SEGMENT_LABELS))
        return finished(box, ordered=True)


@register("box_purchase", _box_sql("total_purchase_amount / 1e6::DOUBLE", 6))
def q_box_purchase(spark, d):
    return _box(spark, d, "total_purchase_amount", 1e6)


@register("box_probability", _box_sql("churn_probability", 6))
def q_box_probability(spark, d):
    return _box(spark, d, "churn_probability", 1.0)


@register("distinct_customers", with_ctes(["tx"], "SELECT DISTINCT customer_id FROM tx"))
def q_distinct_customers(spark, d):
    return stats.distinct_keys(tx(spark, d))


# ---------------------------------------------------------------------------
# Evaluation D24-D26 on the labels table (quality = label, toxic = prediction)
# ---------------------------------------------------------------------------
def _labels(spark, d):
    return bindings.table(spark, d, "labels")


@register("confusion_matrix", """
WITH G AS (SELECT a AS label, b AS prediction FROM (VALUES (0), (1)) x(a), (VALUES (0), (1)) y(b))
SELECT G.label, G.prediction, count(l.doc_id) AS count
FROM G LEFT JOIN labels l ON l.quality = G.label AND l.toxic = G.prediction
GROUP BY G.label, G.prediction""")
def q_confusion_matrix(spark, d):
    return model.confusion_matrix(_labels(spark, d), "quality", "toxic")


@register("accuracy", """
SELECT round(avg(CAST(quality = toxic AS DOUBLE)), 6) AS accuracy, count(*) AS support FROM labels""")
def q_accuracy(spark, d):
    return rounded(model.accuracy(_labels(spark, d), "quality", "toxic"))


_REPORT_SQL = """
WITH C AS (SELECT count(*) AS n, count(*) FILTER (WHERE quality = toxic) AS ok,
  count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS tp0, count(*) FILTER (WHERE toxic = 0) AS pp0,
  count(*) FILTER (WHERE quality = 0) AS sp0,
  count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp1, count(*) FILTER (WHERE toxic = 1) AS pp1,
  count(*) FILTER (WHERE quality = 1) AS sp1 FROM labels),
M AS (SELECT *, coalesce(tp0 / nullif(pp0, 0), 0) AS pr0, coalesce(tp0 / nullif(sp0, 0), 0) AS rc0,
             coalesce(tp1 / nullif(pp1, 0), 0) AS pr1, coalesce(tp1 / nullif(sp1, 0), 0) AS rc1 FROM C),
F AS (SELECT *, coalesce(2 * pr0 * rc0 / nullif(pr0 + rc0, 0), 0) AS f0,
                coalesce(2 * pr1 * rc1 / nullif(pr1 + rc1, 0), 0) AS f1 FROM M)
SELECT '0' AS class, round(pr0, 6) AS precision, round(rc0, 6) AS recall, round(f0, 6) AS f1_score, sp0 AS support FROM F
UNION ALL SELECT '1', round(pr1, 6), round(rc1, 6), round(f1, 6), sp1 FROM F
UNION ALL SELECT 'accuracy', NULL, NULL, round(coalesce(ok / nullif(n, 0), 0), 6), n FROM F
UNION ALL SELECT 'macro avg', round((pr0 + pr1) / 2, 6), round((rc0 + rc1) / 2, 6), round((f0 + f1) / 2, 6), n FROM F
UNION ALL SELECT 'weighted avg', round(coalesce((pr0 * sp0 + pr1 * sp1) / nullif(n, 0), 0), 6),
  round(coalesce((rc0 * sp0 + rc1 * sp1) / nullif(n, 0), 0), 6),
  round(coalesce((f0 * sp0 + f1 * sp1) / nullif(n, 0), 0), 6), n FROM F"""


@register("classification_report", _REPORT_SQL)
def q_classification_report(spark, d):
    return rounded(model.classification_report(_labels(spark, d), "quality", "toxic"))


# ---------------------------------------------------------------------------
# Lists, lookups, predicates
# ---------------------------------------------------------------------------
@register("top_risk", with_ctes(["cu"], """
SELECT customer_id, age, round(total_spent, 2) AS total_spent, region,
  round(churn_probability, 6) AS churn_probability,
  CAST(round_even(churn_probability * 100, 1) AS VARCHAR) || '%' AS churn_percent
FROM cu ORDER BY churn_probability DESC, customer_id LIMIT 10"""), headline=True)
def q_top_risk(spark, d):
    return rounded(lists.top_risk(cu(spark, d)), total_spent=2)


def _high_risk_sql(n: int) -> str:
    return with_ctes(["cu"], f"""
S AS (SELECT *, round_even(churn_probability * 100, 2) AS risk_score FROM cu)
SELECT customer_id, region, subscription_type, total_orders, last_order_days, round(risk_score, 6) AS risk_score,
  round(churn_probability, 6) AS churn_probability
FROM S WHERE coalesce(risk_score >= 70.0, false) ORDER BY risk_score DESC, customer_id LIMIT {n}""")


def _scored(spark, d):
    return cu(spark, d).withColumn("risk_score", F.bround(F.col("churn_probability") * 100, 2))


@register("high_risk_list", _high_risk_sql(50))
def q_high_risk_list(spark, d):
    return rounded(lists.high_risk_list(_scored(spark, d), 70.0, 50))


@register("high_risk_first", _high_risk_sql(10))
def q_high_risk_first(spark, d):
    return rounded(lists.high_risk_list(_scored(spark, d), 70.0, 10))


@register("high_risk_customers", with_ctes(["cu"], """
SELECT customer_id, round(churn_probability, 6) AS churn_probability FROM cu
WHERE coalesce(churn_probability > 0.7::DOUBLE, false)"""))
def q_high_risk_customers(spark, d):
    return rounded(high_risk(cu(spark, d)).select("customer_id", "churn_probability"))


@register("preview", with_ctes(["cu"], """
SELECT customer_id, age, region, customer_type, subscription_type, join_date,
  round(total_spent, 2) AS total_spent, total_orders, round(avg_order_value, 6) AS avg_order_value,
  last_order_days, support_tickets, round(churn_probability, 6) AS churn_probability, churn
FROM cu ORDER BY customer_id LIMIT 10"""))
def q_preview(spark, d):
    return rounded(lists.preview(cu(spark, d)), total_spent=2)


def _first_customer(spark, d):
    """The dashboard's default selection, the first customer id, from the key column alone."""
    return bindings.table(spark, d, "customer").select(F.min("c_custkey")).scalar()


@register("customer_detail", with_ctes(["cu"], """
SELECT customer_id, age, region, customer_type, subscription_type, join_date,
  round(total_spent, 2) AS total_spent, total_orders, round(avg_order_value, 6) AS avg_order_value,
  last_order_days, support_tickets, round(churn_probability, 6) AS churn_probability, churn
FROM cu WHERE customer_id = (SELECT min(customer_id) FROM cu)"""))
def q_customer_detail(spark, d):
    return rounded(lists.customer_detail(cu(spark, d), _first_customer(spark, d)), total_spent=2)


@register("customer_history", with_ctes(["tx"], """
SELECT transaction_id, customer_id, seller_id, transaction_date, round(sales_amount, 2) AS sales_amount,
  service_category, modification_count, round(additional_payment, 4) AS additional_payment,
  round(service_rating, 6) AS service_rating, transaction_canceled, cancellation_date
FROM tx WHERE customer_id = (SELECT min(customer_id) FROM tx)
ORDER BY transaction_date DESC, transaction_id"""))
def q_customer_history(spark, d):
    first = bindings.table(spark, d, "orders").select(F.min("o_custkey")).scalar()
    mine = bindings.transactions(spark, d, customer=first)
    return rounded(lists.customer_history(mine, first), sales_amount=2, additional_payment=4)


@register("customer_activity", with_ctes(["tx"], """
SELECT date_trunc('month', transaction_date) AS month, count(*) AS transactions, round(sum(sales_amount), 2) AS sales,
  CAST(sum(transaction_canceled) AS BIGINT) AS canceled, max(modification_count) AS most_modifications
FROM tx WHERE customer_id = (SELECT max(customer_id) FROM tx) GROUP BY 1"""))
def q_customer_activity(spark, d):
    """B4 + E5: what one customer did per month, from this customer's orders and their lines alone."""
    last = bindings.table(spark, d, "orders").select(F.max("o_custkey")).scalar()
    return lists.customer_activity(bindings.transactions(spark, d, customer=last), last)


@register("order_time_quantiles", """
SELECT service_category, p, round(value, 6) AS value FROM (
  SELECT o_orderpriority AS service_category, unnest([0.01, 0.25, 0.5, 0.75, 0.99]::DOUBLE[]) AS p,
    unnest(quantile_cont(epoch(CAST(o_orderdate AS TIMESTAMP)), [0.01, 0.25, 0.5, 0.75, 0.99])) AS value
  FROM orders WHERE o_orderdate IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY o_orderpriority)""")
def q_order_time_quantiles(spark, d):
    """D17 over seconds since 1970, a narrow band for logarithmic bins."""
    rows = bindings.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("service_category"), F.unix_timestamp("o_orderdate").cast("double").alias("at"))
    return rounded(quantiles(rows, "at", [0.01, 0.25, 0.5, 0.75, 0.99], by=["service_category"], narrow=True))


@register("cancel_scatter", with_ctes(["tx"], """
SELECT transaction_id, modification_count, round(service_rating, 6) AS service_rating,
  CASE WHEN transaction_canceled = 1 THEN 'canceled' ELSE 'kept' END AS series FROM tx"""))
def q_cancel_scatter(spark, d):
    return rounded(lists.cancel_scatter(tx(spark, d)))


# ---------------------------------------------------------------------------
# Checks and report
# ---------------------------------------------------------------------------
_CHECKS_SQL = f"""
T1 AS (SELECT CAST(count(*) AS DOUBLE) AS rws, CAST(min(sales_amount) AS DOUBLE) AS amin,
  CAST(max(sales_amount) AS DOUBLE) AS amax,
  CASE WHEN isnan(corr(modification_count, transaction_canceled)) THEN NULL
       ELSE corr(modification_count, transaction_canceled) END AS cr,
  avg(CAST(transaction_canceled AS DOUBLE)) AS rate,
  CAST(count(*) FILTER (WHERE transaction_id IS NULL) + count(*) FILTER (WHERE customer_id IS NULL)
   + count(*) FILTER (WHERE seller_id IS NULL) + count(*) FILTER (WHERE transaction_date IS NULL)
   + count(*) FILTER (WHERE sales_amount IS NULL) + count(*) FILTER (WHERE service_category IS NULL)
   + count(*) FILTER (WHERE modification_count IS NULL) + count(*) FILTER (WHERE additional_payment IS NULL)
   + count(*) FILTER (WHERE service_rating IS NULL) + count(*) FILTER (WHERE transaction_canceled IS NULL)
   AS DOUBLE) AS nulls FROM tx)
SELECT 'row_count' AS check_name, coalesce(rws = {float(EXPECTED_TRANSACTION_ROWS)}, false) AS passed,
  round(rws, 6) AS value FROM T1
UNION ALL SELECT 'amount_min', coalesce(amin >= {AMOUNT_RANGE[0]}, false), round(amin, 6) FROM T1
UNION ALL SELECT 'amount_max', coalesce(amax <= {AMOUNT_RANGE[1]}, false), round(amax, 6) FROM T1
UNION ALL SELECT 'mod_cancel_corr', coalesce(cr BETWEEN {MOD_CANCEL_CORR_RANGE[0]} AND {MOD_CANCEL_CORR_RANGE[1]}, false),
  round(cr, 6) FROM T1
UNION ALL SELECT 'cancel_rate', coalesce(rate BETWEEN {CANCEL_RATE_RANGE[0]} AND {CANCEL_RATE_RANGE[1]}, false),
  round(rate, 6) FROM T1
UNION ALL SELECT 'no_missing', coalesce(nulls = 0, false), round(nulls, 6) FROM T1
UNION ALL SELECT 'declared_columns', true, 0.0::DOUBLE"""


def _checks(t: DataFrame) -> DataFrame:
    return stats.quality_checks(t, EXPECTED_TRANSACTION_ROWS, AMOUNT_RANGE,
                                MOD_CANCEL_CORR_RANGE, CANCEL_RATE_RANGE,
                                allow_null=["cancellation_date"], schema=BOUND_TRANSACTIONS)


@register("quality_checks", with_ctes(["tx"], _CHECKS_SQL))
def q_quality_checks(spark, d):
    return rounded(_checks(tx(spark, d)))


# ---------------------------------------------------------------------------
# Model features (F5-F7), evaluable in SQL
# ---------------------------------------------------------------------------
_ENC_SQL = """
  CAST(age AS DOUBLE) AS age, round(total_spent, 2) AS total_spent, CAST(total_orders AS DOUBLE) AS total_orders,
  round(coalesce(avg_order_value, 0.0::DOUBLE), 6) AS avg_order_value,
  CAST(coalesce(last_order_days, 0) AS DOUBLE) AS last_order_days,
  CAST(support_tickets AS DOUBLE) AS support_tickets,
  CAST(CASE subscription_type WHEN 'Basic' THEN 0 WHEN 'Premium' THEN 1 WHEN 'Enterprise' THEN 2 ELSE 0 END
       AS DOUBLE) AS subscription_type_encoded,
  CAST(CASE WHEN customer_type = 'company' THEN 1 ELSE 0 END AS DOUBLE) AS customer_type_encoded,
  CAST(CASE region WHEN 'AFRICA' THEN 0 WHEN 'AMERICA' THEN 1 WHEN 'ASIA' THEN 2 WHEN 'EUROPE' THEN 3
       ELSE 5 END AS DOUBLE) AS region_encoded"""


@register("encode_features", with_ctes(["cu"], f"SELECT customer_id, {_ENC_SQL}, churn FROM cu"))
def q_encode_features(spark, d):
    from churnwise.schemas import FEATURES
    enc = model.encode_features(cu(spark, d))
    return rounded(enc.select("customer_id", *FEATURES, "churn"), total_spent=2)


@register("stratified_split", with_ctes(["cu"], """
H AS (SELECT customer_id, churn,
        CAST(CAST(('0x' || substr(md5(CAST(customer_id AS VARCHAR) || '|42'), 1, 13)) AS BIGINT) AS DOUBLE) AS h FROM cu),
K AS (SELECT churn, quantile_cont(h, 0.2) AS q FROM H GROUP BY churn)
SELECT H.customer_id, H.churn FROM H JOIN K ON H.churn = K.churn WHERE h <= q"""))
def q_stratified_split(spark, d):
    _, test = model.stratified_split(cu(spark, d))
    return test.select("customer_id", "churn")


@register("balanced_weight", with_ctes(["cu"], """
K AS (SELECT churn, count(*) AS nc FROM cu GROUP BY churn),
W AS (SELECT churn, CAST(sum(nc) OVER () AS DOUBLE) / (count(*) OVER () * nc) AS class_weight FROM K)
SELECT cu.customer_id, cu.churn, round(W.class_weight, 6) AS class_weight
FROM cu LEFT JOIN W ON cu.churn = W.churn"""))
def q_balanced_weight(spark, d):
    return rounded(model.balanced_weight(cu(spark, d), "churn").select("customer_id", "churn", "class_weight"))


# ---------------------------------------------------------------------------
# Model queries (F8-F14, F17, A7-A9): fitted trees are not SQL-expressible, so
# these carry no oracle; tests check their invariants instead.
# ---------------------------------------------------------------------------
MODELS = FittedModels()
CUSTOMER_TABLES = ("customer", "nation", "region", "orders", "events")  # the tables of ``cu``


def _paths(d, names):
    return [f"{d.rstrip('/')}/{n}.parquet" for n in names]


def fitted_model(spark, d):
    """The fitted pipeline is reused across queries while the files it was trained on stay."""
    return MODELS.get(spark, "full", _paths(d, CUSTOMER_TABLES), lambda: model.train_tree(cu(spark, d)))


@register("train_evaluate", headline=True)
def q_train_evaluate(spark, d):
    """F6-F8 + D26: fit on the 80 % split, report on the held-out 20 %; always trained anew.  The customers are
    written once: the split, the training and the report read them."""
    train, test = model.stratified_split(finished(cu(spark, d)))
    m = model.train_tree(train)
    return finished(rounded(model.classification_report(model.score(m, test), "churn", "predicted_churn")),
                    ordered=True)


@register("model_scores", headline=True)
def q_model_scores(spark, d):
    m = fitted_model(spark, d)
    return rounded(model.score(m, cu(spark, d)).select(
        "customer_id", "churn", "predicted_churn", "churn_probability", "risk_score"))


@register("model_kpis")
def q_model_kpis(spark, d):
    """D13 page variant: predicted rate, high-risk count by score >= 70, mean score."""
    s = model.score(fitted_model(spark, d), cu(spark, d)).drop("churn")
    return rounded(stats.kpis(s, churn_col="predicted_churn", prob_col="risk_score", threshold=70.0,
                              inclusive=True, score_col="risk_score"))


@register("feature_importance")
def q_feature_importance(spark, d):
    return model.feature_importance(model.train_tree(cu(spark, d)), spark)


@register("customer_factors")
def q_customer_factors(spark, d):
    return rounded(model.customer_factors(fitted_model(spark, d), cu(spark, d)))


@register("shap_summary")
def q_shap_summary(spark, d):
    from churnwise.operators import explain
    m = fitted_model(spark, d)
    return explain.shap_summary(explain.shap_values(m, cu(spark, d)))


@register("model_round_trip")
def q_model_round_trip(spark, d):
    """Save, load, score; the loaded model must score identically."""
    from churnwise.sources import io
    path = scratch_path(spark, "model")
    io.save_model(fitted_model(spark, d), path)
    return rounded(model.score(io.load_model(path), cu(spark, d)).select(
        "customer_id", "predicted_churn", "churn_probability", "risk_score"))


@register("stream_scores")
def q_stream_scores(spark, d):
    """customers arriving as Parquet files, scored by a streaming query
    (available-now trigger), read back from the sink."""
    from churnwise.streaming import scoring
    src, sink = scratch_path(spark, "arrivals"), scratch_path(spark, "scores")
    c = cu(spark, d)
    c.write.parquet(src)
    q = scoring.start_scoring(fitted_model(spark, d), scoring.read_customer_stream(spark, src, c.schema),
                              sink, name=f"scores-{abs(hash(sink))}")
    q.awaitTermination()
    return rounded(spark.read.parquet(sink).select(
        "customer_id", "predicted_churn", "churn_probability", "risk_score"))


@contextmanager
def _three_tables(spark, d):
    """Transactions, customers and predictions for queries that read each several times."""
    with ExitStack() as stack:
        t, = stack.enter_context(kept(tx(spark, d)))
        customers, = stack.enter_context(kept(rollups.customer_table(bindings.customers(spark, d), t)))
        scored, = stack.enter_context(kept(rules.rule_risk(customers, t, rating_digits=RATING_DIGITS)))
        yield t, customers, scored


def _difference(name: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """(table_name, rows, mismatches): rows of either side that the other does not have."""
    rows = a.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"))
    odd = a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count(F.lit(1)).alias("mismatches"))
    return rollups.with_scalars(rows, odd)


@register("csv_round_trip", with_ctes(["tx", "ct", "preds"], "\nUNION ALL\n".join(
    f"SELECT '{n}' AS table_name, count(*) AS rows, 0::BIGINT AS mismatches FROM {t}"
    for n, t in (("transactions", "tx"), ("customers", "ct"), ("predictions", "preds")))))
def q_csv_round_trip(spark, d):
    """A1-A4: the three tables written as CSV and read back with their schemas, compared row by row."""
    from churnwise.sources import io
    path = scratch_path(spark, "csv")
    with _three_tables(spark, d) as found:
        tables = dict(zip(("transactions", "customers", "predictions"), found))
        io.write_tables(tables, path)
        back = io.read_tables(spark, path, schemas={k: v.schema for k, v in tables.items()})
        parts = [_difference(k, v, back[k]) for k, v in tables.items()]
        return finished(parts[0].unionByName(parts[1]).unionByName(parts[2]))


# What is wrong with a line of the damaged file, by the row's category (null and other categories: nothing)
_DAMAGE = {"1-URGENT": "bad sales_amount", "2-HIGH": "bad transaction_date", "3-MEDIUM": "malformed row",
           "4-NOT SPECIFIED": "bad cancellation_date"}
_CASE = "CASE service_category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _DAMAGE.items()) + " END"


@register("csv_quarantine", with_ctes(["tx"], f"""
SELECT 'transactions' AS table_name, 'read' AS outcome, NULL AS reason,
  count(*) FILTER (WHERE {_CASE} IS NULL OR {_CASE} = 'bad cancellation_date') AS rows FROM tx
UNION ALL SELECT 'transactions', 'rejected', {_CASE}, count(*) FROM tx
  WHERE {_CASE} IS NOT NULL AND {_CASE} <> 'bad cancellation_date' GROUP BY {_CASE}
UNION ALL SELECT 'transactions', 'nulled', 'bad cancellation_date', count(*) FROM tx
  WHERE {_CASE} = 'bad cancellation_date' HAVING count(*) > 0
UNION ALL SELECT 'transactions', 'read otherwise than written', NULL, 0"""))
def q_csv_quarantine(spark, d):
    """A1-A3: the transactions written with damaged lines; what is read, rejected by reason, or read as null, and
    the rows read that differ from the written ones."""
    from churnwise.sources import io
    path = scratch_path(spark, "damaged")
    with kept(tx(spark, d)) as (t,):
        is_ = {v: F.col("service_category").eqNullSafe(F.lit(k)) for k, v in _DAMAGE.items()}
        cells = {c: F.col(c).cast("string") for c in t.columns}
        for c, text in (("sales_amount", "n/a"), ("transaction_date", "2024-13-45"), ("cancellation_date", "unknown")):
            cells[c] = F.when(is_[f"bad {c}"], F.lit(text)).otherwise(cells[c])
        line = F.to_csv(F.struct(*[v.alias(c) for c, v in cells.items()]))
        t.select(F.when(is_["malformed row"], F.concat(line, F.lit(",1"))).otherwise(line).alias("value")).write.text(
            f"{path}/transactions.csv")
        got = io.read_checked(spark, path, {"transactions": t.schema}, header=False)["transactions"]
        lost = is_["bad sales_amount"] | is_["bad transaction_date"] | is_["malformed row"]
        want = t.where(~lost).withColumn("cancellation_date", F.when(
            ~is_["bad cancellation_date"], F.col("cancellation_date")))
        odd = _difference("transactions", want, got.rows).select(
            "table_name", F.lit("read otherwise than written").alias("outcome"),
            F.lit(None).cast("string").alias("reason"), F.col("mismatches").alias("rows"))
        return finished(io.check_summary("transactions", got).unionByName(odd))


# ---------------------------------------------------------------------------
# The quality report in long form
# ---------------------------------------------------------------------------
def _report_sql() -> str:
    def r(v):
        return f"CASE WHEN abs({v}) >= 1e6 THEN round({v}, 2) ELSE round({v}, 6) END"

    parts = []
    for name, view, ncols in (("transactions", "tx", 11), ("customers", "ct", 8), ("predictions", "preds", 3)):
        parts.append(f"SELECT 'shape' AS section, '{name}.rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM {view}")
        parts.append(f"SELECT 'shape', '{name}.columns', CAST({ncols} AS DOUBLE)")
    for m, e in (("mean", "avg(sales_amount)"), ("std", "stddev_samp(sales_amount)"), ("min", "min(sales_amount)"),
                 ("max", "max(sales_amount)"), ("median", "quantile_cont(sales_amount, 0.5)")):
        parts.append(f"SELECT 'sales_amount', '{m}', CAST({e} AS DOUBLE) FROM tx")
    parts.append("SELECT 'modification_count', 'mean', avg(modification_count) FROM tx")
    parts.append("SELECT 'modification_count', 'max', CAST(max(modification_count) AS DOUBLE) FROM tx")
    parts.append("SELECT 'modification_count.distribution', CAST(modification_count AS VARCHAR), "
                 "CAST(count(*) AS DOUBLE) FROM tx WHERE modification_count IS NOT NULL GROUP BY modification_count")
    parts.append("SELECT 'cancellations', 'event_rate', avg(CAST(transaction_canceled AS DOUBLE)) FROM tx")
    parts.append("SELECT 'cancellations', 'events', CAST(sum(transaction_canceled) AS DOUBLE) FROM tx")
    for a in CORR_COLUMNS:
        for b in CORR_COLUMNS:
            parts.append(f"SELECT 'correlation', '{a}~{b}', CASE WHEN isnan(corr({a}, {b})) THEN NULL "
                         f"ELSE corr({a}, {b}) END FROM tx")
    for m, e in (("mean_purchase", "avg(total_purchase_amount)"), ("customers", "count(total_purchase_amount)"),
                 ("total_purchase", "sum(total_purchase_amount)"),
                 ("mean_modifications", "avg(total_modification_count)"), ("mean_age", "avg(age)")):
        parts.append(f"SELECT 'segment', customer_segment || '.{m}', CAST({e} AS DOUBLE) FROM ct "
                     f"WHERE customer_segment IS NOT NULL GROUP BY customer_segment")
    for m, e in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
        parts.append(f"SELECT 'churn_probability', '{m}', {e}(churn_probability) FROM preds")
    parts.append("SELECT 'risk_level', risk_level, CAST(count(*) AS DOUBLE) FROM preds "
                 "WHERE risk_level IS NOT NULL GROUP BY risk_level")
    t1, checks = _CHECKS_SQL.strip().split("\nSELECT 'row_count'", 1)
    parts.append("SELECT 'checks', check_name, value FROM CK")
    parts.append("SELECT 'checks', check_name || '.passed', CAST(passed AS INTEGER) FROM CK")
    body = f"{t1}, CK AS (SELECT 'row_count'{checks}),\n"
    body += "ALLROWS AS (" + "\nUNION ALL\n".join(parts) + ")\n"
    body += f"SELECT section, metric, {r('value')} AS value FROM ALLROWS"
    return with_ctes(["tx", "ct", "preds"], body)


def _report(spark, d):
    v = F.col("value")
    with _three_tables(spark, d) as (t, customers, scored):
        rep = stats.quality_report(t, customers, scored, checks=_checks(t))
        return finished(rep.select("section", "metric", F.when(F.abs(v) >= 1e6, F.round(v, 2)).otherwise(
            F.round(v, 6)).alias("value")), ordered=True)


@register("quality_report", _report_sql())
def q_quality_report(spark, d):
    return _report(spark, d)


@register("quality_report_text", f"""
SELECT section || ' | ' || metric || ' | ' || CASE WHEN value IS NULL THEN 'NaN'
  WHEN abs(value) >= 1e6 THEN printf('%.2f', value) ELSE printf('%.6f', value) END AS value
FROM ({_report_sql()})""")
def q_quality_report_text(spark, d):
    return stats.report_text(_report(spark, d))


def dashboard_model(spark, d):
    return MODELS.get(spark, "dashboard", _paths(d, CUSTOMER_TABLES),
                      lambda: model.train_tree(cu(spark, d), params=DASHBOARD_TREE))


DASHBOARD_TREE = TreeParams(max_depth=5, min_leaf=1, balanced=False, features=tuple(DASHBOARD_FEATURES))


@register("dashboard_model_scores")
def q_dashboard_model_scores(spark, d):
    """the dashboard form of the tree (depth 5, five features, no weights)."""
    return rounded(model.score(dashboard_model(spark, d), cu(spark, d)).select(
        "customer_id", "churn", "predicted_churn", "churn_probability", "risk_score"))


@register("selected_customer_scores")
def q_selected_customer_scores(spark, d):
    """score the customers picked on the dashboard (here: the first one,
    as the default selection) with the fitted model."""
    picked = model.score_customers(fitted_model(spark, d), cu(spark, d), [_first_customer(spark, d)])
    return rounded(picked.select("customer_id", "predicted_churn", "churn_probability", "risk_score"))


@register("chart_json_round_trip", REGISTRY["amount_histogram"].sql)
def q_chart_json_round_trip(spark, d):
    """A5: a chart dataset written as JSON lines and read back with its schema."""
    from churnwise.sources import io
    path = scratch_path(spark, "chart")
    hist = q_amount_histogram(spark, d)
    io.write_json(hist, path)
    return spark.read.schema(hist.schema).json(path)


# ---------------------------------------------------------------------------
# Facts of the model operators that SQL can state: agreement of two ways to the
# same scores, sums, and what a tree must learn of a planted label.
# ---------------------------------------------------------------------------
def _agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    return _difference("scores", a, b).drop("table_name")


_AGREEMENT_SQL = with_ctes(["cu"], "SELECT count(*) AS rows, 0::BIGINT AS mismatches FROM cu")


@register("model_round_trip_agrees", _AGREEMENT_SQL)
def q_model_round_trip_agrees(spark, d):
    """A model saved and loaded scores every customer as before."""
    scores = model.score(fitted_model(spark, d), cu(spark, d)).select(
        "customer_id", "predicted_churn", "churn_probability", "risk_score")
    return _agreement(rounded(scores), q_model_round_trip(spark, d))


@register("stream_agrees", _AGREEMENT_SQL)
def q_stream_agrees(spark, d):
    """the stream scores every customer as the batch does."""
    scores = model.score(fitted_model(spark, d), cu(spark, d)).select(
        "customer_id", "predicted_churn", "churn_probability", "risk_score")
    return _agreement(rounded(scores), q_stream_scores(spark, d))


@register("shap_adds_up", with_ctes(["cu"], "SELECT count(*) AS rows, 0::BIGINT AS mismatches FROM cu"))
def q_shap_adds_up(spark, d):
    """base value and attributions of each customer sum to the score."""
    from churnwise.operators import explain
    m = fitted_model(spark, d)
    shap = explain.shap_values(m, cu(spark, d))
    parts = F.array(*[F.col(c) for c in shap.columns if c.startswith("shap_")])
    total = shap.select("customer_id", F.aggregate(parts, F.col("base_value"), lambda t, v: t + v).alias("total"))
    scores = model.score(m, cu(spark, d)).select("customer_id", "churn_probability")
    off = F.abs(F.col("total") - F.col("churn_probability")) > 1e-9
    return scores.join(total, "customer_id", "left").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(off, F.lit(True))).alias("mismatches"))


@register("shap_agrees", with_ctes(["cu"], "SELECT count(*) AS rows, 0::BIGINT AS mismatches FROM cu"))
def q_shap_agrees(spark, d):
    """the attributions from expressions are those of the recursion, to 1e-9."""
    from churnwise.operators import explain
    m, rows = fitted_model(spark, d), cu(spark, d)
    a, b = explain.shap_values(m, rows), explain.shap_expressions(m, rows)
    cells = F.array(*[c for c in a.columns if c != "customer_id"])
    both = a.select("customer_id", cells.alias("a")).join(b.select("customer_id", cells.alias("b")), "customer_id", "left")
    off = F.exists(F.zip_with("a", "b", lambda x, y: F.abs(x - y) > 1e-9), lambda v: F.coalesce(v, F.lit(True)))
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(off, F.lit(True))).alias("mismatches"))


@register("exact_root_split", with_ctes(["cu"], f"""
ENC AS (SELECT {_ENC_SQL}, churn FROM cu),
WT AS (SELECT count(*) / (2.0::DOUBLE * count(*) FILTER (WHERE churn = 0)) AS w0,
        count(*) / (2.0::DOUBLE * count(*) FILTER (WHERE churn = 1)) AS w1 FROM ENC),
LNG AS (UNPIVOT ENC ON age, total_spent, total_orders, avg_order_value, last_order_days, support_tickets,
        subscription_type_encoded, customer_type_encoded, region_encoded INTO NAME feature VALUE v),
VALS AS (SELECT feature, v, CAST(count(*) FILTER (WHERE churn = 0) AS BIGINT) AS n0,
        CAST(count(*) FILTER (WHERE churn = 1) AS BIGINT) AS n1 FROM LNG GROUP BY feature, v),
PRE AS (SELECT feature, v, lead(v) OVER o AS nxt, sum(n0) OVER o AS l0, sum(n1) OVER o AS l1,
        sum(n0) OVER (PARTITION BY feature) AS t0, sum(n1) OVER (PARTITION BY feature) AS t1
      FROM VALS WINDOW o AS (PARTITION BY feature ORDER BY v)),
SPL AS (SELECT feature, (v + nxt) / 2 AS threshold, CAST(l0 AS BIGINT) AS l0, CAST(l1 AS BIGINT) AS l1,
        CAST(t0 AS BIGINT) AS zeros, CAST(t1 AS BIGINT) AS ones,
        l1 * w1 * l1 * w1 / (l0 * w0 + l1 * w1) + (t1 - l1) * w1 * (t1 - l1) * w1 / ((t0 - l0) * w0 + (t1 - l1) * w1) AS score
      FROM PRE, WT WHERE nxt IS NOT NULL AND l0 + l1 >= 10 AND t0 + t1 - l0 - l1 >= 10)
SELECT feature, round(threshold, 6) AS threshold, zeros, ones, l0 AS zeros_left, l1 AS ones_left
FROM SPL ORDER BY score DESC, feature, threshold LIMIT 1"""))
def q_exact_root_split(spark, d):
    """F8: the best first split of the churn label over every midpoint of all nine features."""
    from churnwise.operators import exact_tree
    from churnwise.schemas import FEATURES
    rows = rounded(model.encode_features(cu(spark, d)).select(*FEATURES, "churn"), total_spent=2)
    nodes = exact_tree.exact_splits(rows, params=TreeParams(max_depth=1))
    left = nodes.select(F.col("node").alias("left"), F.col("zeros").alias("zeros_left"), F.col("ones").alias("ones_left"))
    return rounded(nodes.where("feature IS NOT NULL").join(left, "left").select(
        "feature", "threshold", "zeros", "ones", "zeros_left", "ones_left"))


@register("exact_planted_scores", with_ctes(["cu"], """
SELECT customer_id, CAST(p AS INTEGER) AS predicted_churn, CAST(CAST(p AS INTEGER) AS DOUBLE) AS churn_probability,
  CAST(p AS INTEGER) * 100.0::DOUBLE AS risk_score
FROM (SELECT customer_id, coalesce(last_order_days > 90 AND total_spent > 100000, false) AS p FROM cu)"""))
def q_exact_planted_scores(spark, d):
    """F8: a label of two limits is learned without a fault from candidate bins that hit neither."""
    from churnwise.operators import exact_tree
    rows = cu(spark, d).drop("churn_probability").withColumn(
        "planted", flag((F.col("last_order_days") > PLANTED_DAYS) & (F.col("total_spent") > 100000)))
    m = exact_tree.train_exact_tree(rows, "planted", TreeParams(max_depth=4, min_leaf=1), min_split=2, bins=16)
    return rounded(model.score(m, rows).select("customer_id", "predicted_churn", "churn_probability", "risk_score"))


@register("importance_adds_up", with_ctes(["cu"], """
SELECT 9::BIGINT AS features, true AS sums_to_one, true AS in_order"""))
def q_importance_adds_up(spark, d):
    """importances of all features, largest first, sum to 1."""
    rows = model.feature_importance(model.train_tree(cu(spark, d)), spark)
    before = F.lag("importance").over(Window.orderBy("rank"))  # one row per feature
    return rows.withColumn("ok", F.coalesce(before >= F.col("importance"), F.lit(True))).agg(
        F.count(F.lit(1)).alias("features"), (F.abs(F.sum("importance") - 1) < 1e-9).alias("sums_to_one"),
        F.bool_and("ok").alias("in_order"))


PLANTED_DAYS = 90
_PLANTED = "CAST(coalesce(last_order_days > 90, false) AS INTEGER)"


def _planted(spark, d):
    """Customers with a label that one feature decides, and the tree that has to find it
    (a bin per value, so that the threshold is among the candidates)."""
    rows = cu(spark, d).drop("churn_probability").withColumn(
        "planted", flag(F.col("last_order_days") > PLANTED_DAYS))
    return rows, model.train_tree(rows, "planted", TreeParams(max_bins=4096))


@register("planted_scores", with_ctes(["cu"], f"""
SELECT customer_id, {_PLANTED} AS planted, {_PLANTED} AS predicted_churn,
  CAST({_PLANTED} AS DOUBLE) AS churn_probability, {_PLANTED} * 100.0::DOUBLE AS risk_score FROM cu"""))
def q_planted_scores(spark, d):
    rows, m = _planted(spark, d)
    return rounded(model.score(m, rows).select("customer_id", "planted", "predicted_churn", "churn_probability",
                                               "risk_score"))


@register("planted_selected_score", with_ctes(["cu"], f"""
SELECT customer_id, {_PLANTED} AS predicted_churn, CAST({_PLANTED} AS DOUBLE) AS churn_probability,
  {_PLANTED} * 100.0::DOUBLE AS risk_score FROM cu WHERE customer_id = (SELECT min(c_custkey) FROM customer)"""))
def q_planted_selected_score(spark, d):
    """the picked customer's score by the tree of the planted label."""
    rows, m = _planted(spark, d)
    return rounded(model.score_customers(m, rows, [_first_customer(spark, d)]).select(
        "customer_id", "predicted_churn", "churn_probability", "risk_score"))


@register("stream_latest_scores", with_ctes(["cu"], """
SELECT customer_id, CASE WHEN region = 'ASIA' THEN TIMESTAMP '2024-01-03 00:00:00' ELSE TIMESTAMP '2024-01-02 00:00:00' END
    AS updated_at, CAST(p AS INTEGER) AS predicted_churn, CAST(CAST(p AS INTEGER) AS DOUBLE) AS churn_probability
FROM (SELECT customer_id, region, coalesce(last_order_days + CASE WHEN region = 'ASIA' THEN 200 ELSE 0 END > 90, false)
  AS p FROM cu)"""))
def q_stream_latest_scores(spark, d):
    """customers arrive, some are corrected, and after a restart outdated versions and repeats of all come
    late; each customer's newest score once."""
    from churnwise.streaming import scoring
    src, sink, log = (scratch_path(spark, n) for n in ("arrivals", "arrival-scores", "arrival-log"))
    rows, m = _planted(spark, d)

    def arrive(df, day):
        df.withColumn("updated_at", F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp_ntz")).write.mode("append").parquet(src)

    def run():
        stream = scoring.read_customer_stream(spark, src, spark.read.parquet(src).schema)
        scoring.start_scoring(m, stream, sink, checkpoint=log).awaitTermination()

    arrive(rows, 2)
    arrive(rows.where("region = 'ASIA'").withColumn("last_order_days", F.col("last_order_days") + 200), 3)
    run()
    arrive(rows.withColumn("last_order_days", F.lit(0).cast(rows.schema["last_order_days"].dataType)), 1)
    arrive(rows, 2)
    run()
    return rounded(scoring.latest_scores(spark.read.parquet(sink)).select(
        "customer_id", "updated_at", "predicted_churn", "churn_probability"))


@register("planted_dashboard_scores", with_ctes(["cu"], f"""
SELECT customer_id, {_PLANTED} AS predicted_churn, CAST({_PLANTED} AS DOUBLE) AS churn_probability FROM cu"""))
def q_planted_dashboard_scores(spark, d):
    rows, _ = cu(spark, d).drop("churn_probability").withColumn(
        "planted", flag(F.col("last_order_days") > PLANTED_DAYS)), None
    m = model.train_tree(rows, "planted", replace(DASHBOARD_TREE, max_bins=4096))
    return rounded(model.score(m, rows).select("customer_id", "predicted_churn", "churn_probability"))


@register("planted_report", with_ctes(["cu"], f"""
C AS (SELECT count(*) AS n, count(*) FILTER (WHERE {_PLANTED} = 0) AS n0,
        count(*) FILTER (WHERE {_PLANTED} = 1) AS n1 FROM cu),
ONE AS (SELECT *, CAST(n0 > 0 AS INTEGER)::DOUBLE AS o0, CAST(n1 > 0 AS INTEGER)::DOUBLE AS o1 FROM C)
SELECT '0' AS class, o0 AS precision, o0 AS recall, o0 AS f1_score, n0 AS support FROM ONE
UNION ALL SELECT '1', o1, o1, o1, n1 FROM ONE
UNION ALL SELECT 'accuracy', NULL, NULL, 1.0::DOUBLE, n FROM ONE
UNION ALL SELECT 'macro avg', (o0 + o1) / 2, (o0 + o1) / 2, (o0 + o1) / 2, n FROM ONE
UNION ALL SELECT 'weighted avg', 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, n FROM ONE"""))
def q_planted_report(spark, d):
    rows, m = _planted(spark, d)
    return rounded(model.classification_report(model.score(m, rows), "planted", "predicted_churn"))


@register("planted_factors", with_ctes(["cu"], """
SELECT customer_id, 'last_order_days' AS feature, 1.0::DOUBLE AS importance,
  CAST(coalesce(last_order_days, 0) AS DOUBLE) AS value, 1 AS rank FROM cu"""))
def q_planted_factors(spark, d):
    rows, m = _planted(spark, d)
    return rounded(model.customer_factors(m, rows, n=1))


@register("planted_kpis", with_ctes(["cu"], f"""
SELECT round(avg(CAST({_PLANTED} AS DOUBLE)) * 100, 6) AS churn_rate,
  count(*) FILTER (WHERE {_PLANTED} = 1) AS high_risk_customers, count(*) AS customers,
  round(avg({_PLANTED} * 100.0::DOUBLE), 6) AS mean_risk_score FROM cu"""))
def q_planted_kpis(spark, d):
    """D13, page variant on predictions."""
    rows, m = _planted(spark, d)
    scored = model.score(m, rows).drop("churn")
    return rounded(stats.kpis(scored, prob_col="risk_score", threshold=70.0, inclusive=True, score_col="risk_score"))


@register("planted_distribution", with_ctes(["cu"], f"""
SELECT 0 AS class, count(*) FILTER (WHERE {_PLANTED} = 0) AS count FROM cu
UNION ALL SELECT 1, count(*) FILTER (WHERE {_PLANTED} = 1) FROM cu"""))
def q_planted_distribution(spark, d):
    """D12, predicted variant."""
    rows, m = _planted(spark, d)
    return stats.churn_distribution(model.score(m, rows), "predicted_churn")


# ---------------------------------------------------------------------------
# Display helpers, declared orders, numeric columns, as-of stamp
# ---------------------------------------------------------------------------
@register("display_values", with_ctes(["cu"], """
SELECT 'CUST_' || lpad(CAST(customer_id AS VARCHAR), 5, '0') AS customer_key,
  printf('%.1f%%', churn_probability * 100.0::DOUBLE) AS percent,
  format('{:,}', CAST(round_even(total_spent, 0) AS BIGINT)) AS spent,
  upper(substr(customer_type, 1, 1)) || substr(customer_type, 2) AS type_title,
  'Last Order Days' AS factor_title, 'LAST ORDER DAYS' AS factor_heading,
  CAST(churn_probability > 0.5::DOUBLE AS INTEGER) AS predicted FROM cu"""))
def q_display_values(spark, d):
    factor = F.lit("last_order_days")
    return cu(spark, d).select(
        padded_key("customer_id").alias("customer_key"), percent_text("churn_probability").alias("percent"),
        thousands("total_spent").alias("spent"), title_case("customer_type").alias("type_title"),
        title_case(factor).alias("factor_title"), upper_name(factor).alias("factor_heading"),
        to_class("churn_probability").alias("predicted"))


def _ranked(df: DataFrame, *cols: str) -> DataFrame:
    """The order in which a short sorted list comes out, as a rank."""
    at = df.select(*cols, F.monotonically_increasing_id().alias("_at"))
    return at.select(*cols, F.row_number().over(Window.orderBy("_at")).cast("long").alias("rank"))


@register("segment_order", with_ctes(["ct"], """
SELECT customer_segment, row_number() OVER (ORDER BY CASE customer_segment WHEN 'regular' THEN 0
  WHEN 'premium' THEN 1 ELSE 2 END) AS rank FROM (SELECT DISTINCT customer_segment FROM ct)"""))
def q_segment_order(spark, d):
    """Categories in their declared order."""
    return _ranked(stats.order_by_category(ct(spark, d).select("customer_segment").distinct(), "customer_segment",
                                           SEGMENT_LABELS), "customer_segment")


@register("category_order", with_ctes(["tx"], """
G AS (SELECT service_category, count(*) AS count FROM tx WHERE service_category IS NOT NULL GROUP BY 1)
SELECT 'value' AS sort, service_category, count, row_number() OVER (ORDER BY service_category) AS rank FROM G
UNION ALL SELECT 'count', service_category, count, row_number() OVER (ORDER BY count DESC, service_category) FROM G"""))
def q_category_order(spark, d):
    """Both sort orders of the value counts."""
    parts = [_ranked(stats.value_counts(tx(spark, d), "service_category", sort=s), "service_category", "count")
             .withColumn("sort", F.lit(s)) for s in ("value", "count")]
    return parts[0].unionByName(parts[1])


_NUMERIC = ("age", "total_spent", "total_orders", "avg_order_value", "last_order_days", "support_tickets",
            "churn_probability", "churn")


@register("numeric_null_counts", with_ctes(["cu"], "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count, false AS allowed FROM cu"
    for c in _NUMERIC)))
def q_numeric_null_counts(spark, d):
    """The numeric columns of the customers, key left out."""
    c = cu(spark, d)
    return stats.null_counts(c.select(*numeric_columns(c)))


@register("stamped_shape", with_ctes(["tx", "A"], """
SELECT 'transactions' AS table_name, count(*) AS rows, 11 AS columns, (SELECT as_of FROM A) AS as_of FROM tx"""))
def q_stamped_shape(spark, d):
    """A figure with the as-of moment of the data."""
    return stats.table_shape(tx(spark, d), "transactions").select("*", as_of_stamp(bindings.as_of(spark, d)))


@register("available_columns", with_ctes(["cu"], "SELECT customer_id, region, churn FROM cu"))
def q_available_columns(spark, d):
    """B1: the wanted columns that exist, in the wanted order."""
    return select_available(cu(spark, d), ["customer_id", "region", "seller_rank", "churn"])
