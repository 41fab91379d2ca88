"""Business rules as single column expressions.

Each rule is one projection over a joined or rolled-up DataFrame; the global
scalars a rule needs (a quantile, a mean and deviation) are one-row aggregates
attached by broadcast, so nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnwise.functions.columns import band, clip, cut, flag, null_false, round_even, zscore
from churnwise.operators.quantiles import quantile_row
from churnwise.operators.rollups import behaviour_rollup, with_scalars
from churnwise.schemas import (GAUGE_EDGES, GAUGE_LABELS, RISK_EDGES, RISK_LABELS,
                               ChurnLabelParams, PropensityParams, RuleRiskParams)


def _when(cond: Column, weight: float) -> Column:
    return F.when(null_false(cond), F.lit(weight)).otherwise(F.lit(0.0))


# F2 ---------------------------------------------------------------------------
def rule_score(avg_mods: Column, total_payment: Column, duration_days: Column, avg_rating: Column,
               segment: Column, cancellations: Column, params: RuleRiskParams = RuleRiskParams()) -> Column:
    """Rule-based churn score in the original order of operations:
    four additive signals, then the premium discount, then the cancellation
    bonus, then clipping to [0, 1]."""
    p = params
    s = (F.lit(0.0)
         + _when(avg_mods >= F.lit(p.high_mod_threshold), p.high_mod_weight)
         + _when(total_payment == F.lit(0), p.no_payment_weight)
         + _when(duration_days < F.lit(p.short_duration_days), p.short_duration_weight)
         + _when(avg_rating < F.lit(p.low_rating_threshold), p.low_rating_weight))
    s = F.when(null_false(segment.isin(*p.premium_segments)), s * F.lit(p.premium_factor)).otherwise(s)
    s = s + _when(cancellations > F.lit(0), p.cancellation_weight)
    return clip(s, 0.0, 1.0)


def rule_risk(customers: DataFrame, tx: DataFrame, params: RuleRiskParams = RuleRiskParams(),
              rating_digits: int | None = None, include_lowest: bool = False,
              keep: tuple = ()) -> DataFrame:
    """Predictions table ``(customer_id, churn_probability, risk_level)``, plus
    the ``keep`` columns of ``customers`` carried through (saves joining the
    predictions back to the customer table).

    ``customers`` is the customer table with ``customer_segment`` (D3); the
    behaviour columns come from the transaction-side rollup only (C2), so a
    customer without transactions triggers no rule and scores 0 with a null
    band (S3) unless ``include_lowest``.  ``rating_digits`` rounds the ratings and their
    mean to that many decimals and makes the mean independent of summation order (see
    ``exact_mean``), for data whose means fall on the threshold.
    """
    beh = behaviour_rollup(tx, rating_digits).select(
        "customer_id", "avg_modification_count", F.col("total_additional_payment").alias("tx_payment"),
        "transaction_duration_days", "avg_rating", "total_cancellations")
    carried = [c for c in keep if c not in ("customer_id", "customer_segment")]
    j = customers.select("customer_id", "customer_segment", *carried).join(beh, "customer_id", "left")
    rating = F.col("avg_rating")
    if rating_digits is not None:
        rating = F.round(rating, rating_digits)
    score = rule_score(F.col("avg_modification_count"), F.col("tx_payment"),
                       F.col("transaction_duration_days"), rating,
                       F.col("customer_segment"), F.col("total_cancellations"), params)
    extra = [c for c in keep if c != "customer_id"]
    return (j.select("customer_id", *extra, score.alias("_p"))
            .select("customer_id",
                    round_even("_p", 4).alias("churn_probability"),
                    cut("_p", RISK_EDGES, RISK_LABELS, include_lowest=include_lowest).alias("risk_level"),
                    *extra))


# F3 ---------------------------------------------------------------------------
def churn_label(df: DataFrame, params: ChurnLabelParams = ChurnLabelParams(),
                noise_col: str | None = None, exact: bool = True, values: DataFrame | None = None) -> DataFrame:
    """Add ``churn_probability`` (rule score) and ``churn`` (score > threshold).

    The low-value signal compares with the 25 % quantile of ``avg_order_value``
    over all rows (nulls skipped); the original random term is an optional column.
    ``values`` supplies the same ``avg_order_value`` from a smaller plan, so that the
    quantile's passes need not evaluate ``df``.
    """
    p = params
    q = quantile_row(df if values is None else values, "avg_order_value", [p.low_value_quantile], ["_q_low"],
                     exact=exact)
    score = (flag(F.col("last_order_days") > F.lit(p.inactive_days)) * F.lit(p.inactive_weight)
             + flag(F.col("support_tickets") > F.lit(p.tickets)) * F.lit(p.tickets_weight)
             + flag(F.col("total_orders") < F.lit(p.few_orders)) * F.lit(p.few_orders_weight)
             + flag(F.col("avg_order_value") < F.col("_q_low")) * F.lit(p.low_value_weight))
    if noise_col is not None:
        score = score + F.col(noise_col) * F.lit(p.low_value_weight)
    return (with_scalars(df, q)
            .withColumn("churn_probability", score)
            .withColumn("churn", flag(F.col("churn_probability") > F.lit(p.threshold)))
            .drop("_q_low"))


# F4 ---------------------------------------------------------------------------
def cancel_propensity(tx: DataFrame, params: PropensityParams = PropensityParams()) -> DataFrame:
    """Add ``cancel_propensity``; the amount term is a z-score against the global
    mean and sample deviation (one-row aggregate, broadcast)."""
    p = params
    moments = tx.agg(F.avg("sales_amount").alias("_mean"), F.stddev_samp("sales_amount").alias("_std"))
    z = zscore("sales_amount", F.col("_mean"), F.col("_std"))
    prob = (F.lit(p.base)
            + F.col("modification_count") / F.lit(p.mod_divisor) * F.lit(p.mod_corr) * F.lit(p.mod_scale)
            + flag(F.col("additional_payment") == F.lit(0)) * F.lit(p.payment_corr) * F.lit(p.payment_scale)
            + (F.lit(p.rating_top) - F.col("service_rating")) / F.lit(p.rating_divisor)
            * F.lit(p.rating_corr) * F.lit(p.rating_scale)
            + (-z) * F.lit(p.amount_corr) * F.lit(p.amount_scale))
    return (with_scalars(tx, moments)
            .withColumn("cancel_propensity", clip(prob, p.lower, p.upper))
            .drop("_mean", "_std"))


# F15 --------------------------------------------------------------------------
def risk_gauge(df: DataFrame, score_col: str = "risk_score", reference: float = 50.0,
               alert: float = 90.0) -> DataFrame:
    """Gauge dataset per row: score, band label (left-closed 30 / 70), delta to
    the reference, and whether the alert line is reached."""
    s = F.col(score_col)
    return df.select(
        "customer_id", s.alias("risk_score"),
        band(s, GAUGE_EDGES, GAUGE_LABELS).alias("gauge_label"),
        (s - F.lit(reference)).alias("delta"),
        null_false(s >= F.lit(alert)).alias("alert"))
