"""Churn model: features, split, weights, tree, scoring, importances and
evaluation (F5-F13, D24-D26).

The tree is Spark ML's ``DecisionTreeRegressor`` on the 0/1 label (variance
impurity = half the Gini impurity for 0/1 labels, and the leaf mean is the
churn probability; see SURVEY 2.9.1).  Training is distributed: each level is
one pass that aggregates split statistics per node and bin on the executors.
Evaluation metrics are single aggregations over the scored rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnwise.functions.columns import encode, equals_flag, round_even, to_class
from churnwise.operators.quantiles import quantiles
from churnwise.schemas import (COMPANY_LABEL, FEATURES, REGION_CODES, REGION_DEFAULT,
                               SUBSCRIPTION_CODES, SUBSCRIPTION_DEFAULT, TreeParams)
from churnwise.session import finished

FEATURE_VECTOR = "features"
WEIGHT = "class_weight"


# F5 ---------------------------------------------------------------------------
def encode_features(df: DataFrame, features: Sequence[str] = FEATURES,
                    region_codes: Mapping[str, int] = REGION_CODES,
                    company_label: str = COMPANY_LABEL) -> DataFrame:
    """Add the encoded categorical columns and make every available feature a
    non-null double (missing values become 0)."""
    cols = set(df.columns)
    out = df
    if "subscription_type" in cols:
        out = out.withColumn("subscription_type_encoded",
                             encode("subscription_type", SUBSCRIPTION_CODES, SUBSCRIPTION_DEFAULT))
    if "customer_type" in cols:
        out = out.withColumn("customer_type_encoded", equals_flag("customer_type", company_label))
    if "region" in cols:
        out = out.withColumn("region_encoded", encode("region", region_codes, REGION_DEFAULT))
    present = set(out.columns)
    return out.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0))
                            for f in features if f in present})


# F6 ---------------------------------------------------------------------------
def split_hash(key: str = "customer_id", seed: int = 42) -> Column:
    """The first 52 bits of md5(key || '|' || seed) as a double (exact); DuckDB computes the
    same value."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")


def stratified_split(df: DataFrame, key: str = "customer_id", test: float = 0.2,
                     seed: int = 42, label: str = "churn", broadcast: bool = True) -> tuple[DataFrame, DataFrame]:
    """(train, test): of each class the rows whose key hash is at most the class's ``test``
    quantile of the hash, which is that share of its rows to within one row.

    The split depends on keys and labels only, so it is repeatable on any partitioning.
    Rows with a null label are split as a class of their own.  The limits are found from keys and
    labels alone and read as one map; beyond ``BROADCAST_TARGETS`` classes pass ``broadcast=False``,
    which joins them by class."""
    rows = df.withColumn("_h", split_hash(key, seed)).withColumn("_class", F.coalesce(
        F.col(label).cast("string"), F.lit("null label")))
    cuts = quantiles(rows.select("_h", "_class"), "_h", [test], by=["_class"], broadcast=broadcast).select(
        "_class", F.col("value").alias("_cut"))
    if broadcast:
        limit = cuts.agg(F.map_from_entries(F.collect_list(F.struct("_class", "_cut")))).scalar()  # an entry per class
        marked = rows.withColumn("_test", F.col("_h") <= F.try_element_at(limit, F.col("_class")))
    else:
        marked = rows.join(cuts, "_class").withColumn("_test", F.col("_h") <= F.col("_cut"))
    return (marked.where(~F.col("_test")).select(*df.columns), marked.where(F.col("_test")).select(*df.columns))


# F7 ---------------------------------------------------------------------------
MOST_CLASSES = 1000


def balanced_weight(df: DataFrame, label: str = "churn", out: str = WEIGHT) -> DataFrame:
    """Add n / (k * n_class).  The weights are one map with an entry per label value,
    read as a scalar, so no row is exchanged; more than ``MOST_CLASSES`` values raise."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    few = F.when(F.count(F.lit(1)) <= MOST_CLASSES, F.count(F.lit(1))).otherwise(
        F.raise_error(F.lit(f"more than {MOST_CLASSES} classes in {label}")).cast("long"))
    entries = F.map_from_entries(F.collect_list(F.struct(F.col(label), F.col("_nc"))))
    one = counts.agg(F.transform_values(entries, lambda _, v: F.lit(1.0) / v).alias("_inv"),
                     (F.sum("_nc") / few).alias("_share"))
    weight = one.select(F.transform_values("_inv", lambda _, v: F.col("_share") * v)).scalar()
    return df.withColumn(out, F.try_element_at(weight, F.col(label)))


# F8 / F9 ----------------------------------------------------------------------
def train_tree(df: DataFrame, label: str = "churn", params: TreeParams = TreeParams()) -> PipelineModel:
    """Fit assembler + regression tree on encoded rows.  Returns the fitted
    pipeline; the assembler keeps the ordered feature names.

    The features and labels are written once and every pass of the training reads them: a task of a
    pass over the plan of ``df`` itself would send back the metrics of all its operators."""
    data = encode_features(df, params.features).withColumn("_label", F.col(label).cast("double"))
    data = finished(data.select(*[f for f in params.features if f in data.columns], "_label"))
    stages = [VectorAssembler(inputCols=list(params.features), outputCol=FEATURE_VECTOR)]
    tree = DecisionTreeRegressor(featuresCol=FEATURE_VECTOR, labelCol="_label", predictionCol="_p",
                                 maxDepth=params.max_depth, minInstancesPerNode=params.min_leaf,
                                 maxBins=params.max_bins, seed=params.seed, impurity="variance")
    if params.balanced:
        data = balanced_weight(data, "_label")
        tree = tree.setWeightCol(WEIGHT)
    stages.append(tree)
    return Pipeline(stages=stages).fit(data)


def feature_names(model: PipelineModel) -> list[str]:
    return list(model.stages[0].getInputCols())


# F10 / F11 --------------------------------------------------------------------
def score(model: PipelineModel, df: DataFrame, keep_features: bool = False) -> DataFrame:
    """Add ``predicted_churn``, ``churn_probability`` (leaf mean of class 1) and
    ``risk_score`` (probability x 100, half-even to 2 digits).  The input
    columns keep their values; ``keep_features`` adds the encoded features."""
    names = feature_names(model)
    kept = [c for c in df.columns if c != "churn_probability"]
    held = df.select(*[F.col(c).alias(f"_in_{i}") for i, c in enumerate(kept)], *df.columns)
    enc = encode_features(held, names)
    scored = model.transform(enc)
    p = F.least(F.greatest(F.col("_p"), F.lit(0.0)), F.lit(1.0))
    extra = [F.col(f) for f in names if f not in df.columns] if keep_features else []
    return scored.select(*[F.col(f"_in_{i}").alias(c) for i, c in enumerate(kept)], *extra,
                         to_class(p).alias("predicted_churn"),
                         p.alias("churn_probability"),
                         round_even(p * 100, 2).alias("risk_score"))


def score_customers(model: PipelineModel, df: DataFrame, ids: Sequence, key: str = "customer_id") -> DataFrame:
    return score(model, df.where(F.col(key).isin(*ids)))


# F12 --------------------------------------------------------------------------
def importances(model: PipelineModel) -> list[tuple[str, float]]:
    """(feature, importance) from the fitted tree, largest first (driver-side
    model metadata: one value per feature)."""
    vals = model.stages[-1].featureImportances.toArray().tolist()
    return sorted(zip(feature_names(model), vals), key=lambda kv: (-kv[1], kv[0]))


def feature_importance(model: PipelineModel, spark, top_n: int | None = None) -> DataFrame:
    rows = importances(model)[: top_n] if top_n else importances(model)
    return spark.createDataFrame([(n, float(v), i + 1) for i, (n, v) in enumerate(rows)],
                                 "feature string, importance double, rank int")


# F13 --------------------------------------------------------------------------
def customer_factors(model: PipelineModel, df: DataFrame, n: int = 3, key: str = "customer_id") -> DataFrame:
    """Per customer, the n most important features with their importance and the
    customer's (encoded) value.  Importance is global, so the n features are
    chosen once from the model and the rows are one projection + unpivot."""
    top = importances(model)[:n]
    enc = encode_features(df, [f for f, _ in top])
    cells = [F.struct(F.lit(f).alias("feature"), F.lit(float(v)).alias("importance"),
                      F.col(f).cast("double").alias("value"), F.lit(i + 1).alias("rank"))
             for i, (f, v) in enumerate(top)]
    return enc.select(key, F.inline(F.array(*cells)))


# D24 --------------------------------------------------------------------------
def confusion_matrix(df: DataFrame, label: str, pred: str, classes: Sequence[int] = (0, 1)) -> DataFrame:
    """``(label, prediction, count)`` for every class pair, zeros included; one
    aggregation with a counter per cell."""
    y, p = F.col(label), F.col(pred)
    one = df.agg(*[F.count_if((y == a) & (p == b)).alias(f"_m{i}_{j}")
                   for i, a in enumerate(classes) for j, b in enumerate(classes)])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("label"), F.lit(b).alias("prediction"), F.col(f"_m{i}_{j}").alias("count"))
        for i, a in enumerate(classes) for j, b in enumerate(classes)])))


# D25 --------------------------------------------------------------------------
def accuracy(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"),
                  F.count(F.lit(1)).alias("support"))


# D26 --------------------------------------------------------------------------
def classification_report(df: DataFrame, label: str, pred: str, classes: Sequence[int] = (0, 1)) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and
    support-weighted means; an empty denominator gives 0."""
    y, p = F.col(label), F.col(pred)
    aggs = [F.count(F.lit(1)).alias("_n"), F.count_if(y == p).alias("_ok")]
    for i, c in enumerate(classes):
        aggs += [F.count_if((y == c) & (p == c)).alias(f"_tp{i}"),
                 F.count_if(p == c).alias(f"_pp{i}"),
                 F.count_if(y == c).alias(f"_sp{i}")]
    one = df.agg(*aggs)

    def div(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    prec = [div(F.col(f"_tp{i}"), F.col(f"_pp{i}")) for i in range(len(classes))]
    rec = [div(F.col(f"_tp{i}"), F.col(f"_sp{i}")) for i in range(len(classes))]
    f1 = [div(2 * pr * rc, pr + rc) for pr, rc in zip(prec, rec)]
    sup = [F.col(f"_sp{i}") for i in range(len(classes))]
    k = float(len(classes))

    def mean(xs):
        s = xs[0]
        for x in xs[1:]:
            s = s + x
        return s / F.lit(k)

    def wmean(xs):
        s = xs[0] * sup[0]
        for x, w in zip(xs[1:], sup[1:]):
            s = s + x * w
        return div(s, F.col("_n"))

    def row(name, a, b, c, d):
        return F.struct(F.lit(name).alias("class"), a.cast("double").alias("precision"),
                        b.cast("double").alias("recall"), c.cast("double").alias("f1_score"),
                        d.cast("long").alias("support"))

    rows = [row(str(c), prec[i], rec[i], f1[i], sup[i]) for i, c in enumerate(classes)]
    nul = F.lit(None).cast("double")
    rows.append(row("accuracy", nul, nul, div(F.col("_ok"), F.col("_n")), F.col("_n")))
    rows.append(row("macro avg", mean(prec), mean(rec), mean(f1), F.col("_n")))
    rows.append(row("weighted avg", wmean(prec), wmean(rec), wmean(f1), F.col("_n")))
    return one.select(F.inline(F.array(*rows)))
