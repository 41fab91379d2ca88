"""Aggregations and statistics.

Every statistic is a hash aggregate (partial on the map side, final after one
shuffle on the grouping key) or, for global figures, an aggregate without keys
whose partial results are a few bytes per task.  Grouping keys drop nulls (S1).
Global scalars needed by a second pass (min/max of a histogram, quartiles of a
box plot) are one-row DataFrames joined back, never collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnwise.functions.columns import cut, month, numeric_columns, per_unit, round_even
from churnwise.operators.correlation import wide_correlation
from churnwise.operators.quantiles import moments_and_median, quantiles
from churnwise.schemas import AGE_EDGES, AGE_LABELS


def _keyed(df: DataFrame, key: str) -> DataFrame:
    """Group-by input without null keys (pandas drops them, Spark keeps them)."""
    return df.where(F.col(key).isNotNull())


def _rate(label: str) -> Column:
    return F.avg(F.col(label).cast("double"))


# D4 / D8 ----------------------------------------------------------------------
def segment_stats(customers: DataFrame, by: str = "customer_segment") -> DataFrame:
    """Mean, count and sum of purchases, mean modifications and mean age per segment."""
    cols = set(customers.columns)
    aggs = [F.avg("total_purchase_amount").alias("mean_purchase"),
            F.count("total_purchase_amount").alias("customers"),
            F.sum("total_purchase_amount").alias("total_purchase")]
    if "total_modification_count" in cols:
        aggs.append(F.avg("total_modification_count").alias("mean_modifications"))
    if "age" in cols:
        aggs.append(F.avg("age").alias("mean_age"))
    return _keyed(customers, by).groupBy(by).agg(*aggs)


# D12 --------------------------------------------------------------------------
def churn_distribution(df: DataFrame, col: str = "churn") -> DataFrame:
    """``(class, count)`` for classes 0 and 1; an absent class counts 0."""
    c = F.col(col)
    one = df.agg(F.count_if(c == 0).alias("c0"), F.count_if(c == 1).alias("c1"))
    return one.select(F.inline(F.array(
        F.struct(F.lit(0).alias("class"), F.col("c0").alias("count")),
        F.struct(F.lit(1).alias("class"), F.col("c1").alias("count")))))


# D5 ---------------------------------------------------------------------------
def segment_churn(df: DataFrame, col: str | None = None, label: str = "churn") -> DataFrame:
    """Churn rate (percent, half-even to 2 digits) and row count per segment.

    Without ``col`` the subscription type is used, else the customer type; with
    neither the churn distribution is returned, as in the original chart.
    """
    if col is None:
        col = next((c for c in ("subscription_type", "customer_type") if c in df.columns), None)
        if col is None:
            return churn_distribution(df, label)
    return (_keyed(df, col).groupBy(col)
            .agg(_rate(label).alias("_m"), F.count(label).alias("customers"))
            .select(col, round_even(F.col("_m") * 100, 2).alias("churn_rate"), "customers"))


# D6 ---------------------------------------------------------------------------
def region_churn(df: DataFrame, label: str = "churn", col: str = "region") -> DataFrame:
    return _keyed(df, col).groupBy(col).agg((_rate(label) * 100).alias("churn_rate"))


# D7 ---------------------------------------------------------------------------
def age_group_churn(df: DataFrame, label: str = "churn") -> DataFrame:
    """Churn rate per right-closed age group; ages outside (0, 100] are dropped."""
    g = df.select(cut("age", AGE_EDGES, AGE_LABELS).alias("age_group"), label)
    return _keyed(g, "age_group").groupBy("age_group").agg((_rate(label) * 100).alias("churn_rate"))


# D9 ---------------------------------------------------------------------------
def monthly_churn(df: DataFrame, date_col: str = "join_date", label: str = "churn") -> DataFrame:
    g = df.select(month(date_col).alias("year_month"), label)
    return (_keyed(g, "year_month").groupBy("year_month")
            .agg(_rate(label).alias("_m"), F.count(label).alias("customers"))
            .select("year_month", round_even(F.col("_m") * 100, 2).alias("churn_rate"), "customers"))


# D10 --------------------------------------------------------------------------
def monthly_transactions(tx: DataFrame, date_col: str = "transaction_date",
                         flag_col: str = "transaction_canceled") -> DataFrame:
    g = tx.select(month(date_col).alias("year_month"), flag_col)
    return (_keyed(g, "year_month").groupBy("year_month")
            .agg(F.count(F.lit(1)).alias("transactions"),
                 (_rate(flag_col) * 100).alias("cancel_rate")))


# D11 --------------------------------------------------------------------------
def value_counts(df: DataFrame, col: str, sort: str = "count") -> DataFrame:
    """``(col, count)`` without nulls, by descending count or by value."""
    g = _keyed(df, col).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    if sort == "count":
        return g.orderBy(F.desc("count"), F.asc(col))
    if sort == "value":
        return g.orderBy(col)
    raise ValueError("sort must be 'count' or 'value'")


# D13 --------------------------------------------------------------------------
def kpis(df: DataFrame, churn_col: str = "churn", prob_col: str = "churn_probability",
         threshold: float = 0.7, inclusive: bool = False, score_col: str | None = None) -> DataFrame:
    """One row: churn rate (percent), high-risk count, customers, and the mean
    risk score when ``score_col`` is given.  A missing ``churn_col`` falls back
    to ``predicted_churn``."""
    if churn_col not in df.columns:
        churn_col = "predicted_churn"
    p = F.col(prob_col)
    risky = (p >= F.lit(threshold)) if inclusive else (p > F.lit(threshold))
    aggs = [(_rate(churn_col) * 100).alias("churn_rate"),
            F.count_if(risky).alias("high_risk_customers"),
            F.count(F.lit(1)).alias("customers")]
    if score_col is not None:
        aggs.append(F.avg(score_col).alias("mean_risk_score"))
    return df.agg(*aggs)


# D14 --------------------------------------------------------------------------
def table_shape(df: DataFrame, name: str = "table") -> DataFrame:
    return df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"),
                  F.lit(len(df.columns)).alias("columns"))


# D15 --------------------------------------------------------------------------
def describe_column(df: DataFrame, col: str, exact: bool = True) -> DataFrame:
    """Mean, sample deviation, min, max and (interpolated) median in one row; nulls and
    NaN are skipped, and without any value all five are null."""
    if exact:
        return moments_and_median(df, col).select(F.lit(col).alias("column_name"), "*")
    v = F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))
    moments = df.agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
                     F.max(v).alias("max"), F.percentile_approx(v, 0.5).alias("median"))
    return moments.select(F.lit(col).alias("column_name"), "*")


# D16 --------------------------------------------------------------------------
def event_rate(df: DataFrame, col: str = "transaction_canceled") -> DataFrame:
    return df.agg(_rate(col).alias("event_rate"), F.sum(col).cast("long").alias("events"))


# D18 / S10 --------------------------------------------------------------------
def safe_corr(a, b) -> Column:
    """Pearson correlation over pairs where both values are present; NULL (not an
    error) when either side is constant or fewer than two pairs exist."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    a2 = F.when(b.isNotNull(), a.cast("double"))
    b2 = F.when(a.isNotNull(), b.cast("double"))
    return F.try_divide(F.covar_samp(a2, b2), F.stddev_samp(a2) * F.stddev_samp(b2))


def pair_corr(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), safe_corr(a, b).alias("corr"))


# D19 --------------------------------------------------------------------------
WIDE = 16  # columns beyond which the pairs no longer fit one generated aggregation


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Long form ``(col_a, col_b, corr)`` for every ordered pair, from one
    aggregation holding the n(n+1)/2 distinct pairs; beyond ``WIDE`` columns
    from matrix products in the tasks (``correlation.wide_correlation``)."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    if len(cols) > WIDE:
        return wide_correlation(df, cols)
    aggs, cells = [], []
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            aggs.append(safe_corr(a, cols[j]).alias(f"_c{i}_{j}"))
    one = df.agg(*aggs)
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            name = f"_c{min(i, j)}_{max(i, j)}"
            cells.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                                  F.col(name).alias("corr")))
    return one.select(F.inline(F.array(*cells)))


# D20 --------------------------------------------------------------------------
def missing(df: DataFrame, col: str) -> Column:
    """Null, or NaN in a floating-point column."""
    c = F.col(col)
    if isinstance(df.schema[col].dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def null_counts(df: DataFrame, allow: Sequence[str] = ()) -> DataFrame:
    """``(column_name, null_count, allowed)`` per column, one pass; NaN counts as missing."""
    one = df.agg(*[F.count_if(missing(df, c)).alias(f"_n{i}") for i, c in enumerate(df.columns)])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"_n{i}").alias("null_count"),
                 F.lit(c in allow).alias("allowed"))
        for i, c in enumerate(df.columns)])))


def total_nulls(df: DataFrame, allow: Sequence[str] = ()) -> Column:
    """Aggregate expression: null cells over all columns not in ``allow``."""
    parts = [F.count_if(missing(df, c)) for c in df.columns if c not in allow]
    out = F.lit(0).cast("long")
    for p in parts:
        out = out + p
    return out


# D21 --------------------------------------------------------------------------
def bin_index(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin on [lo, hi] by comparison with the bin edges, top edge closed (S14):
    the computed index moves by one where rounding put a value on the wrong side."""
    def edge(i: Column) -> Column:
        return F.when(i == bins, hi).otherwise(i * ((hi - lo) / F.lit(bins)) + lo)
    guess = F.least(F.floor((x - lo) / (hi - lo) * F.lit(bins)), F.lit(bins - 1).cast("long"))
    return guess + F.when(x < edge(guess), F.lit(-1)).when(
        (x >= edge(guess + 1)) & (guess < bins - 1), F.lit(1)).otherwise(F.lit(0))


def histogram(df: DataFrame, col: str, bins: int = 30, divisor: float = 1.0) -> DataFrame:
    """``(bin, bin_start, bin_end, count)`` for all ``bins`` bins, empty ones included.

    Values are divided by ``divisor``; nulls, NaN and infinities are not counted.  A
    constant column has the range half a unit around its value.  Two passes: a global
    min/max (one row, broadcast) and a grouped count; the bin list is generated from that
    one row, so nothing depends on the driver.
    """
    x = per_unit(col, divisor).alias("_x")
    vals = df.select(x).where(F.abs("_x") < float("inf"))
    ends = vals.agg(F.min("_x").alias("_a"), F.max("_x").alias("_b"))
    half = F.when(F.col("_a") == F.col("_b"), F.lit(0.5)).otherwise(F.lit(0.0))
    rng = ends.select((F.col("_a") - half).alias("_lo"), (F.col("_b") + half).alias("_hi"))
    counts = (vals.crossJoin(F.broadcast(rng))
              .select(bin_index(F.col("_x"), F.col("_lo"), F.col("_hi"), bins).alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    edges = rng.where(F.col("_lo").isNotNull()).select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"),
        "_lo", "_hi")
    step = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    return (edges.join(counts, "bin", "left")
            .select("bin", (F.col("bin") * step + F.col("_lo")).alias("bin_start"),
                    F.when(F.col("bin") == bins - 1, F.col("_hi"))
                    .otherwise((F.col("bin") + 1) * step + F.col("_lo")).alias("bin_end"),
                    F.coalesce(F.col("count"), F.lit(0).cast("long")).alias("count")))


# D22 / E3 ---------------------------------------------------------------------
def box_summary(df: DataFrame, group: str, col: str, divisor: float = 1.0,
                order: Sequence[str] | None = None, exact: bool = True, broadcast: bool = True) -> DataFrame:
    """Quartiles, 1.5 x IQR whiskers (most extreme values inside the fences)
    and outlier count per group; rows ordered by the declared category order.

    Beyond ``BROADCAST_TARGETS`` groups and probabilities pass ``broadcast=False``, which joins the
    quartiles by key, as in ``quantiles``; a sketch (``exact=False``) always does."""
    vals = _keyed(df, group).select(group, per_unit(col, divisor).alias("_x"))
    q = quantiles(vals, "_x", [0.25, 0.5, 0.75], by=[group], exact=exact, broadcast=broadcast)
    wide = q.groupBy(group).agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n)
                                  for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    fences = wide.select(group, "q1", "median", "q3",
                         (F.col("q3") - F.col("q1")).alias("iqr"),
                         (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("_lf"),
                         (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("_uf"))
    x = F.col("_x")
    inside = (x >= F.col("_lf")) & (x <= F.col("_uf"))
    # a row per group, no more than quantiles() has just broadcast
    fences = F.broadcast(fences) if exact and broadcast else fences
    out = (vals.where(x.isNotNull() & ~F.isnan(x)).join(fences, group)
           .groupBy(group, "q1", "median", "q3", "iqr")
           .agg(F.min(F.when(inside, x)).alias("lower_whisker"),
                F.max(F.when(inside, x)).alias("upper_whisker"),
                F.count_if(~inside).alias("outliers"),
                F.count(F.lit(1)).alias("n")))
    if order is not None:
        out = order_by_category(out, group, order)
    return out


def order_by_category(df: DataFrame, col: str, order: Sequence[str]) -> DataFrame:
    """Sort by a declared category order; unknown values go last."""
    rank = F.create_map(*[x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i))])
    return df.orderBy(F.coalesce(F.try_element_at(rank, F.col(col)), F.lit(len(order))), F.col(col))


# D23 --------------------------------------------------------------------------
def distinct_keys(df: DataFrame, col: str = "customer_id") -> DataFrame:
    return df.select(col).distinct()


# F16 --------------------------------------------------------------------------
def quality_checks(tx: DataFrame, expected_rows: int, amount_range: tuple, corr_range: tuple,
                   cancel_range: tuple, allow_null: Sequence[str] = (),
                   schema: T.StructType | None = None) -> DataFrame:
    """Check list ``(check_name, passed, value)`` from one aggregation.

    Checks: row count, smallest and largest amount, modification/cancel correlation range,
    cancel-rate range, no missing values outside ``allow_null`` and, given a
    ``schema``, that every declared column is present with its type.
    """
    one = tx.agg(
        F.count(F.lit(1)).cast("double").alias("rows"),
        F.min("sales_amount").cast("double").alias("amin"),
        F.max("sales_amount").cast("double").alias("amax"),
        safe_corr("modification_count", "transaction_canceled").alias("corr"),
        _rate("transaction_canceled").alias("rate"),
        total_nulls(tx, allow_null).cast("double").alias("nulls"))
    lo_a, hi_a = amount_range
    lo_c, hi_c = corr_range
    lo_r, hi_r = cancel_range

    def chk(name, passed, value):
        return F.struct(F.lit(name).alias("check_name"), F.coalesce(passed, F.lit(False)).alias("passed"),
                        value.cast("double").alias("value"))

    cells = [
        chk("row_count", F.col("rows") == F.lit(float(expected_rows)), F.col("rows")),
        chk("amount_min", F.col("amin") >= lo_a, F.col("amin")),
        chk("amount_max", F.col("amax") <= hi_a, F.col("amax")),
        chk("mod_cancel_corr", F.col("corr").between(lo_c, hi_c), F.col("corr")),
        chk("cancel_rate", F.col("rate").between(lo_r, hi_r), F.col("rate")),
        chk("no_missing", F.col("nulls") == 0, F.col("nulls")),
    ]
    if schema is not None:
        have = {f.name: f.dataType for f in tx.schema.fields}
        missing = sum(1 for f in schema.fields if have.get(f.name) != f.dataType)
        cells.append(chk("declared_columns", F.lit(missing == 0), F.lit(float(missing))))
    return one.select(F.inline(F.array(*cells)))


# A6 ---------------------------------------------------------------------------
def _stack(one: DataFrame, section: str, metrics: Sequence[str]) -> DataFrame:
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(section).alias("section"), F.lit(m).alias("metric"),
                 F.col(m).cast("double").alias("value")) for m in metrics])))


def quality_report(tx: DataFrame, customers: DataFrame, predictions: DataFrame,
                   exact: bool = True, checks: DataFrame | None = None) -> DataFrame:
    """The report as ``(section, metric, value)``: table shapes, amount and
    modification statistics, cancellations, the correlation matrix, segment
    statistics, probability statistics, the risk-level distribution and, given
    the rows of ``quality_checks``, the check list (each check's value, and
    whether it passed as 1 or 0).

    All transaction-level scalars (shape, moments, modification statistics,
    cancellations and every correlation pair) come from one aggregation; the
    median, the modification distribution and the grouped sections are the
    only other passes over the transactions."""
    corr_cols = ["sales_amount", "modification_count", "additional_payment", "service_rating",
                 "transaction_canceled"]
    pairs = [(a, b) for i, a in enumerate(corr_cols) for b in corr_cols[i:]]
    one = tx.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("sales_amount").alias("mean"), F.stddev_samp("sales_amount").alias("std"),
        F.min("sales_amount").alias("min"), F.max("sales_amount").alias("max"),
        F.avg("modification_count").alias("mod_mean"), F.max("modification_count").alias("mod_max"),
        _rate("transaction_canceled").alias("event_rate"), F.sum("transaction_canceled").alias("events"),
        *[safe_corr(a, b).alias(f"_c_{a}_{b}") for a, b in pairs])
    med = quantiles(tx, "sales_amount", [0.5], exact=exact).select(F.col("value").alias("median"))
    one = one.crossJoin(F.broadcast(med))

    def cell(section, metric, value):
        return F.struct(F.lit(section).alias("section"), F.lit(metric).alias("metric"),
                        value.cast("double").alias("value"))

    def corr_name(a, b):
        i, j = sorted((corr_cols.index(a), corr_cols.index(b)))
        return f"_c_{corr_cols[i]}_{corr_cols[j]}"

    cells = [cell("shape", "transactions.rows", F.col("rows")),
             cell("shape", "transactions.columns", F.lit(len(tx.columns)))]
    cells += [cell("sales_amount", m, F.col(m)) for m in ("mean", "std", "min", "max", "median")]
    cells += [cell("modification_count", "mean", F.col("mod_mean")),
              cell("modification_count", "max", F.col("mod_max")),
              cell("cancellations", "event_rate", F.col("event_rate")),
              cell("cancellations", "events", F.col("events"))]
    cells += [cell("correlation", f"{a}~{b}", F.col(corr_name(a, b))) for a in corr_cols for b in corr_cols]
    parts = [one.select(F.inline(F.array(*cells)))]
    for name, d in (("customers", customers), ("predictions", predictions)):
        parts.append(table_shape(d, name).select(F.inline(F.array(
            F.struct(F.lit("shape").alias("section"), F.lit(f"{name}.rows").alias("metric"),
                     F.col("rows").cast("double").alias("value")),
            F.struct(F.lit("shape").alias("section"), F.lit(f"{name}.columns").alias("metric"),
                     F.col("columns").cast("double").alias("value"))))))
    dist = _keyed(tx, "modification_count").groupBy("modification_count").agg(F.count(F.lit(1)).alias("n"))
    parts.append(dist.select(F.lit("modification_count.distribution").alias("section"),
                             F.col("modification_count").cast("string").alias("metric"),
                             F.col("n").cast("double").alias("value")))
    seg = segment_stats(customers)
    seg_metrics = [c for c in seg.columns if c != "customer_segment"]
    parts.append(seg.select(F.inline(F.array(*[
        F.struct(F.lit("segment").alias("section"),
                 F.concat_ws(".", F.col("customer_segment"), F.lit(m)).alias("metric"),
                 F.col(m).cast("double").alias("value")) for m in seg_metrics]))))
    prob = predictions.agg(F.avg("churn_probability").alias("mean"),
                           F.stddev_samp("churn_probability").alias("std"),
                           F.min("churn_probability").alias("min"), F.max("churn_probability").alias("max"))
    parts.append(_stack(prob, "churn_probability", ["mean", "std", "min", "max"]))
    levels = _keyed(predictions, "risk_level").groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))
    parts.append(levels.select(F.lit("risk_level").alias("section"), F.col("risk_level").alias("metric"),
                               F.col("n").cast("double").alias("value")))
    if checks is not None:
        parts.append(checks.select(F.inline(F.array(
            F.struct(F.lit("checks").alias("section"), F.col("check_name").alias("metric"), F.col("value")),
            F.struct(F.lit("checks").alias("section"), F.concat("check_name", F.lit(".passed")).alias("metric"),
                     F.col("passed").cast("int").cast("double").alias("value"))))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report_text(report: DataFrame) -> DataFrame:
    """One text line per report row, for ``write.text``; values with six decimals, from a
    million on (amounts) with two."""
    v = F.col("value")
    text = F.when(F.abs(v) >= 1e6, F.format_string("%.2f", v)).when(v.isNotNull(), F.format_string("%.6f", v))
    return report.select(F.format_string("%s | %s | %s", "section", "metric", F.coalesce(text, F.lit("NaN")))
                         .alias("value"))

