"""Exact interpolated quantiles that stay distributed.

Spark's exact ``percentile`` merges a value->count map of every distinct value into one
task per group; at cluster scale that is one task holding billions of entries.  Here the
exact answer takes two passes over the rows:

1. Rows are counted per group and logarithmic bin, a monotone integer of the value with
   ``BINS_PER_E`` bins per factor e.  Counts, smallest and largest value (and, on request,
   moments) are combined map-side; a running sum over the bins of a group finds the bin
   that holds each wanted rank.  The bins of a group are at most a few million whatever the
   number of rows.
2. Rows of the wanted bins (about n / BINS_PER_E of a group's rows) are counted per distinct
   value.  Values in a narrow band (times of a few days, ids near a thousand million) can all
   lie in one bin; with ``narrow`` the counts of a wanted bin are summed again over ``LINEAR_BINS`` equal
   stretches between its smallest and largest value, and a running sum over these finds the
   stretch of the wanted rank.  A bin spans a factor of about 1 + 1 / BINS_PER_E, so a
   stretch has at most about 7 million doubles, and far fewer unless they are neighbours.
3. A running sum over the values of that bin or stretch gives x[j] and x[j+1], which are interpolated
   linearly (x[j] + (p(n-1) - j) * (x[j+1] - x[j]), the usual "type 7" definition).

With ``narrow`` no task sorts more than the bins, the stretches or the values of one stretch of a group,
however many rows and distinct values it has.

Nulls and NaN are skipped; without any value the quantiles are null.  ``exact=False``
returns the values of a sketch instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_ACCURACY = 10_000
BINS_PER_E = 10_000
# ln of the smallest double is -744.4, so this makes the bin of every positive value positive
BIN_SHIFT = 8_000_000
LINEAR_BINS = 1 << 16  # stretches of a wanted bin
BROADCAST_TARGETS = 100_000  # (group, probability) rows broadcast at most


def value_bin(v: Column) -> Column:
    """A long that never decreases as ``v`` grows; 0 for zero, infinities at the ends."""
    size = F.least(F.floor(F.log(F.abs(v)) * F.lit(float(BINS_PER_E))), F.lit(BIN_SHIFT)) + F.lit(BIN_SHIFT)
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0).cast("long"))


def _targets(vals: DataFrame, by: Sequence[str], probs: Sequence[float], moments: bool) -> DataFrame:
    """One row per group and probability: the bin of rank j = floor(p(n-1)) and what is
    known about it."""
    aggs = [F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    if moments:
        aggs += [F.avg("_v").alias("_m"), F.var_pop("_v").alias("_s2")]
    bins = vals.groupBy(*by, "_bin").agg(*aggs)
    group = Window.partitionBy(*by)
    order = group.orderBy("_bin")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = F.col("_c")
    cols = [F.sum("_c").over(group).alias("_n"), (F.sum("_c").over(running) - c).alias("_before"),
            F.lead("_lo").over(order).alias("_next")]
    if moments:
        mean = F.sum(c * F.col("_m")).over(group) / F.sum("_c").over(group)
        cols += [mean.alias("_mean"), F.min("_lo").over(group).alias("_min"), F.max("_hi").over(group).alias("_max")]
    out = bins.select(*bins.columns, *cols)
    kept = ["_n", "_before", "_c", "_lo", "_hi", "_next"]
    if moments:
        off = F.col("_m") - F.col("_mean")
        out = out.withColumn("_ss", F.sum(c * (F.col("_s2") + off * off)).over(group))
        std = F.when(F.col("_n") > 1, F.sqrt(F.col("_ss") / (F.col("_n") - 1)))
        out = out.withColumn("_std", std)
        kept += ["_mean", "_std", "_min", "_max"]
    wanted = F.array(*[F.struct(F.lit(i).alias("_i"), F.floor(F.lit(p) * (F.col("_n") - 1)).alias("_j"),
                                F.lit(p).alias("_p")) for i, p in enumerate(probs)])
    hit = F.filter(wanted, lambda t: (t["_j"] >= F.col("_before")) & (t["_j"] < F.col("_before") + F.col("_c")))
    return out.select(*by, "_bin", *kept, F.inline(hit))


def _in_stretch(counts: DataFrame, by: Sequence[str], broadcast: bool = True) -> DataFrame:
    """Of the counted values of the wanted bins those of the stretch that holds the wanted rank,
    with ``_before`` and ``_next`` of the stretch.  There are as many stretches as wanted bins."""
    width = F.col("_hi") - F.col("_lo")
    part = F.least(F.floor((F.col("_v") - F.col("_lo")) / width * F.lit(float(LINEAR_BINS))), F.lit(LINEAR_BINS - 1))
    counts = counts.withColumn("_part", F.when(width > 0, part).otherwise(F.lit(0)).cast("long"))
    parts = counts.groupBy(*by, "_i", "_part").agg(
        F.sum("_k").alias("_pc"), F.min("_v").alias("_first"), F.max("_j").alias("_rank"),
        F.max("_before").alias("_start"), F.max("_next").alias("_end"))
    order = Window.partitionBy(*by, "_i").orderBy("_part")
    upto = F.col("_start") + F.sum("_pc").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts = parts.select(*by, "_i", "_part", "_rank", "_pc", upto.alias("_upto"),
                         F.coalesce(F.lead("_first").over(order), "_end").alias("_after"))
    held = (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_pc"))
    wanted = parts.where(held).select(*by, "_i", "_part", (F.col("_upto") - F.col("_pc")).alias("_start"), "_after")
    return counts.join(F.broadcast(wanted) if broadcast else wanted, [*by, "_i", "_part"]).withColumns(
        {"_before": F.col("_start"), "_next": F.col("_after")}).drop("_start", "_after", "_part")


def _picked(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str], moments: bool,
            broadcast: bool, narrow: bool = False) -> DataFrame:
    v = F.col("_v")
    vals = (df.select(*by, F.col(col).cast("double").alias("_v")).where(v.isNotNull() & ~F.isnan(v))
            .withColumn("_bin", value_bin(v)))
    targets = _targets(vals, by, probs, moments)
    if broadcast:
        rows = F.count(F.lit(1)).over(Window.partitionBy())
        few = F.when(rows <= BROADCAST_TARGETS, F.col("_bin")).otherwise(F.raise_error(F.lit(
            f"more than {BROADCAST_TARGETS} groups and probabilities: pass broadcast=False")).cast("long"))
        targets = F.broadcast(targets.withColumn("_bin", few) if by else targets)
    keys = [*by, "_bin"]
    carried = [c for c in targets.columns if c not in keys]
    counts = vals.join(targets, keys).groupBy(*keys, *carried, "_v").agg(F.count(F.lit(1)).alias("_k"))
    counts = _in_stretch(counts, by, broadcast) if narrow else counts
    one = Window.partitionBy(*by, "_i")
    upto = F.col("_before") + F.sum("_k").over(one.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.withColumn("_upto", upto)
    held = [c for c in carried if c not in ("_i", "_p")]
    picked = ranked.groupBy(*by, "_i").agg(
        F.first("_p").alias("p"), *[F.first(c).alias(c) for c in held],
        F.min(F.when(F.col("_upto") > F.col("_j"), v)).alias("_x"),
        F.min(F.when(F.col("_upto") > F.col("_j") + 1, v)).alias("_x1"))
    frac = F.col("p") * (F.col("_n") - 1) - F.col("_j")
    above = F.coalesce("_x1", "_next", "_x")
    # equal neighbours need no arithmetic (and infinities would give NaN)
    value = F.when((frac == 0) | (above == F.col("_x")), F.col("_x")).otherwise(
        F.col("_x") + frac * (above - F.col("_x")))
    return picked.withColumn("value", value)


def quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = (),
              exact: bool = True, accuracy: int = DEFAULT_ACCURACY, broadcast: bool = True, narrow: bool = False) -> DataFrame:
    """One row per group and probability: ``(*by, p, value)``; nulls and NaN are skipped.

    Pass ``narrow`` for columns whose values lie in a narrow band (times, ids): the values of a wanted
    bin are then told apart by stretches (step 2 above), which costs another pass over the rows of the bin.
    The result is the same without it; one task then sorts the distinct values of a wanted bin.

    Without ``by`` there is a row per probability even when there are no values.  The
    wanted bins (groups times probabilities) are broadcast so that no row is exchanged
    before it is counted; beyond ``BROADCAST_TARGETS`` of them pass ``broadcast=False``,
    which joins by group and bin.
    """
    by = list(by)
    probs = [float(p) for p in probs]
    if not probs or any(p < 0 or p > 1 for p in probs):
        raise ValueError("probabilities must lie in [0, 1]")
    if exact:
        picked = _picked(df, col, probs, by, False, broadcast, narrow).select(*by, "_i", "p", "value")
    else:
        v = F.col(col).cast("double")
        vals = df.select(*by, v.alias("_v")).where(~F.isnan(v) & v.isNotNull())
        sketch = vals.groupBy(*by).agg(
            F.percentile_approx("_v", F.array(*[F.lit(p) for p in probs]), accuracy).alias("_q"))
        picked = sketch.select(*by, F.posexplode("_q").alias("_i", "value")).withColumn(
            "p", F.array(*[F.lit(p) for p in probs])[F.col("_i")])
    if by:
        return picked.select(*by, "p", "value")
    one = picked.agg(*[F.max(F.when(F.col("_i") == i, F.col("value"))).alias(f"_v{i}") for i in range(len(probs))])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(p).alias("p"), F.col(f"_v{i}").alias("value")) for i, p in enumerate(probs)])))


def quantile_row(df: DataFrame, col: str, probs: Sequence[float], names: Sequence[str],
                 exact: bool = True, accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """One-row DataFrame with one column per probability, for ``crossJoin``."""
    q = quantiles(df, col, probs, exact=exact, accuracy=accuracy)
    return q.agg(*[F.max(F.when(F.col("p") == F.lit(float(p)), F.col("value"))).alias(n)
                   for p, n in zip(probs, names)])


def moments_and_median(df: DataFrame, col: str) -> DataFrame:
    """One row (mean, std, min, max, median) in the two passes of the median; nulls when
    there are no values."""
    picked = _picked(df, col, [0.5], [], True, True)
    return picked.agg(*[F.max(c).alias(n) for c, n in (
        ("_mean", "mean"), ("_std", "std"), ("_min", "min"), ("_max", "max"), ("value", "median"))])
