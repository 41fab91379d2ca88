"""Model invariants: importances, score range, persistence, stream = batch,
SHAP additivity and exactness, recovery on held-out rows."""

import itertools
import math
import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnwise import schemas
from churnwise.functions.columns import band, cut
from churnwise.operators import explain, model, rollups
from churnwise.plans import catalog
from churnwise.schemas import DASHBOARD_FEATURES, TreeParams
from churnwise.session import checkpoint_dir
from churnwise.sources import io
from churnwise.streaming import scoring

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def data(spark):
    cu = catalog.cu(spark, SF)
    # flip a deterministic tenth of the labels so the tree has work to do
    noisy = cu.withColumn("churn", F.when(F.col("customer_id") % 10 == 3, 1 - F.col("churn"))
                          .otherwise(F.col("churn")))
    return noisy.cache()


@pytest.fixture(scope="module")
def fitted(data):
    return model.train_tree(data, params=TreeParams(max_depth=6, min_leaf=10))


def _scratch(spark, name):
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def test_importances_sum_to_one(fitted):
    imp = model.importances(fitted)
    assert [n for n, _ in imp] and sum(v for _, v in imp) == pytest.approx(1.0)


def test_score_columns_and_ranges(fitted, data):
    s = model.score(fitted, data)
    r = s.agg(F.min("churn_probability"), F.max("churn_probability"),
              F.max(F.abs(F.col("risk_score") - F.bround(F.col("churn_probability") * 100, 2))),
              F.count_if(F.col("predicted_churn") != (F.col("churn_probability") > 0.5).cast("int"))).first()
    assert 0.0 <= r[0] <= r[1] <= 1.0
    assert r[2] == 0.0 and r[3] == 0
    assert s.where(F.col("age") != F.col("age").cast("int")).count() == 0
    assert s.schema["age"].dataType.simpleString() == "int"


def test_save_load_same_scores(spark, fitted, data):
    path = _scratch(spark, "m")
    io.save_model(fitted, path)
    loaded = io.load_model(path)
    assert model.feature_names(loaded) == model.feature_names(fitted)
    a = model.score(fitted, data).select("customer_id", F.col("churn_probability").alias("a"))
    b = model.score(loaded, data).select("customer_id", F.col("churn_probability").alias("b"))
    assert a.join(b, "customer_id").where(F.col("a") != F.col("b")).count() == 0


def test_stream_equals_batch(spark, fitted, data):
    src, sink = _scratch(spark, "src"), _scratch(spark, "sink")
    data.repartition(3).write.parquet(src)
    q = scoring.start_scoring(fitted, scoring.read_customer_stream(spark, src, data.schema, 1), sink,
                              name=uuid.uuid4().hex)
    q.awaitTermination()
    batch = model.score(fitted, data).select("customer_id", F.col("churn_probability").alias("a"))
    stream = spark.read.parquet(sink).select("customer_id", F.col("churn_probability").alias("b"))
    assert stream.count() == batch.count()
    assert batch.join(stream, "customer_id").where(F.col("a") != F.col("b")).count() == 0


def test_shap_additive_and_exact(spark, fitted, data):
    sv = explain.shap_values(fitted, data)
    pred = model.score(fitted, data).select("customer_id", F.col("churn_probability").alias("p"))
    err = sv.join(pred, "customer_id").agg(F.max(F.abs(F.col("prediction") - F.col("p")))).first()[0]
    assert err < 1e-9
    nodes = explain.tree_nodes(fitted, spark)
    names = model.feature_names(fitted)
    x = np.array(model.encode_features(data, names).select(*names).limit(3).toPandas(), dtype=float)
    phi, _ = explain.tree_shap(nodes, x)

    def cond(row, s, j=0):
        if nodes["left"][j] < 0:
            return nodes["value"][j]
        f, lc, rc, c = nodes["feature"][j], nodes["left"][j], nodes["right"][j], nodes["cover"]
        if f in s:
            return cond(row, s, lc if row[f] <= nodes["threshold"][j] else rc)
        return (c[lc] * cond(row, s, lc) + c[rc] * cond(row, s, rc)) / c[j]

    m = len(names)
    for r in range(len(x)):
        for i in range(m):
            others = [k for k in range(m) if k != i]
            brute = sum(math.factorial(len(s)) * math.factorial(m - len(s) - 1) / math.factorial(m)
                        * (cond(x[r], set(s) | {i}) - cond(x[r], set(s)))
                        for size in range(m) for s in itertools.combinations(others, size))
            assert phi[r, i] == pytest.approx(brute, abs=1e-12)
    top = explain.shap_summary(sv, top=3).collect()
    assert len(top) == 3 and top[0]["mean_abs_shap"] >= top[-1]["mean_abs_shap"]


def test_shap_without_python(fitted, data):
    """Expressions give what the recursion gives, in a plan without a Python node; NaN and a tree of one leaf too."""
    odd = data.withColumn("total_spent", F.when(F.col("customer_id") % 7 == 0, float("nan")).otherwise(F.col("total_spent")))
    one_leaf = model.train_tree(data, params=TreeParams(max_depth=0))
    for m, rows in ((fitted, odd), (one_leaf, data)):
        a, b = explain.shap_values(m, rows), explain.shap_expressions(m, rows)
        assert a.columns == b.columns and a.dtypes == b.dtypes
        names = [c for c in a.columns if c != "customer_id"]
        both = a.join(b.select("customer_id", *[F.col(c).alias(f"_{c}") for c in names]), "customer_id")
        off = both.select(F.greatest(*[F.abs(F.col(c) - F.col(f"_{c}")) for c in names]).alias("off"))
        n, most = off.agg(F.count("off"), F.max("off")).first()
        assert n == data.count() and most < 1e-12
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_recovery_beats_majority(spark, data):
    train, test = model.stratified_split(data)
    m = model.train_tree(train, params=TreeParams(max_depth=10, min_leaf=10))
    s = model.score(m, test)
    acc = model.accuracy(s, "churn", "predicted_churn").first()["accuracy"]
    pos = test.agg(F.avg("churn")).first()[0]
    assert acc > max(pos, 1 - pos)


def test_dashboard_form_and_factors(spark, data):
    m = model.train_tree(data, params=TreeParams(max_depth=5, min_leaf=1, balanced=False,
                                                 features=tuple(DASHBOARD_FEATURES)))
    assert model.feature_names(m) == list(DASHBOARD_FEATURES)
    f = model.customer_factors(m, data, n=3)
    assert f.count() == 3 * data.count()
    assert f.groupBy("customer_id").count().where("count != 3").count() == 0


def test_balanced_weight(spark):
    df = spark.createDataFrame([(0,)] * 30 + [(1,)] * 10, "churn int")
    w = {r["churn"]: r["class_weight"] for r in model.balanced_weight(df).distinct().collect()}
    assert w[0] == pytest.approx(40 / 60) and w[1] == pytest.approx(40 / 20)


def test_split_is_repeatable(spark, data):
    _, a = model.stratified_split(data)
    _, b = model.stratified_split(data.repartition(5))
    assert sorted(r[0] for r in a.select("customer_id").collect()) == \
        sorted(r[0] for r in b.select("customer_id").collect())


def test_split_share_per_class(spark):
    df = spark.range(5000).selectExpr("id AS customer_id", "CAST(id % 17 = 0 AS INT) AS churn")
    train, test = model.stratified_split(df)
    n = {r["churn"]: r["count"] for r in df.groupBy("churn").count().collect()}
    got = {r["churn"]: r["count"] for r in test.groupBy("churn").count().collect()}
    assert all(abs(got[c] - 0.2 * n[c]) <= 1 for c in n)
    assert train.count() + test.count() == 5000


def test_split_of_few_and_null_labels(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (3, None)], "customer_id long, churn int")
    train, test = model.stratified_split(df)
    assert train.count() + test.count() == 3


def test_too_many_classes_raise(spark, monkeypatch):
    monkeypatch.setattr(model, "MOST_CLASSES", 1)
    with pytest.raises(Exception, match="more than 1 classes"):
        model.balanced_weight(spark.createDataFrame([(0,), (1,)], "churn int")).collect()


def test_original_vocabulary(spark):
    """Tables that carry the original category names."""
    df = spark.createDataFrame([("서울", "기업", "Premium"), ("제주", "개인", None)],
                               "region string, customer_type string, subscription_type string")
    got = model.encode_features(df, region_codes=schemas.ORIGINAL_REGION_CODES,
                                company_label=schemas.ORIGINAL_COMPANY_LABEL).collect()
    assert [(r["region_encoded"], r["customer_type_encoded"], r["subscription_type_encoded"]) for r in got] == [
        (0.0, 1.0, 1.0), (5.0, 0.0, 0.0)]
    amounts = spark.createDataFrame([(float(i),) for i in range(10)], "total_purchase_amount double")
    seg = rollups.assign_segment(amounts, labels=schemas.ORIGINAL_SEGMENT_LABELS)
    assert [r[0] for r in seg.groupBy("customer_segment").count().orderBy("count", "customer_segment")
            .select("customer_segment").collect()] == ["VIP", "프리미엄", "일반"]
    risk = spark.createDataFrame([(0.1, 10.0), (0.9, 90.0)], "p double, s double").select(
        cut("p", schemas.RISK_EDGES, schemas.ORIGINAL_RISK_LABELS).alias("r"),
        band("s", schemas.GAUGE_EDGES, schemas.ORIGINAL_GAUGE_LABELS).alias("g")).collect()
    assert [tuple(r) for r in risk] == [("낮음", "낮음"), ("높음", "높음")]


def test_split_without_a_map_of_classes(spark):
    df = spark.range(3000).select(F.col("id").alias("customer_id"), (F.col("id") % 3).alias("churn"), F.lit("x").alias("_h"))
    parts = [[sorted(r["customer_id"] for r in part.collect()) for part in model.stratified_split(
        df.drop("_h"), broadcast=b)] for b in (True, False)]
    assert parts[0] == parts[1] and len(parts[0][1]) == pytest.approx(600, abs=3)


def test_training_evaluates_its_input_once(spark):
    """The weights and all passes of the training read written rows, not the plan of the input."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(300).select(F.col("id").alias("customer_id"), (F.col("id") % 2).alias("churn"),
                                   *[(F.col("id") % (i + 2)).cast("double").alias(f)
                                     for i, f in enumerate(schemas.FEATURES)])
    m = model.train_tree(rows.mapInArrow(counted, rows.schema), params=TreeParams(max_depth=3, min_leaf=1))
    assert m.stages[-1].numNodes > 1
    assert seen.value == 300


def test_train_evaluate_reads_written_customers(spark, monkeypatch):
    train, seen = model.train_tree, []
    monkeypatch.setattr(model, "train_tree", lambda df: seen.append(df.inputFiles()) or train(df))
    assert catalog.REGISTRY["train_evaluate"].run(spark, "/root/testdata/sf0.001").count() == 5
    assert seen[0] and all("/finished-" in f for f in seen[0])
