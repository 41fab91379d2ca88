"""Decision tree with exact thresholds (F8): at every node the best midpoint between any two
neighbouring values of any feature, not the best of a fixed set of bins.

A level of the tree is two grouped passes over the rows, for all its nodes at once:

1. rows, ones and range of every (node, feature, bin).  The best border between bins is the score to
   beat.  The score of a split is convex in what goes left, so no split inside a bin scores more than the
   best corner of the bin's rectangle; bins that cannot reach the best border are done.
2. the distinct values of the bins that are left are counted, sorted bin by bin and tried one by one.

Both passes are combined map-side and hand on counts; the driver reads one split per node.  A task sorts the
distinct values of one bin, about one in ``bins`` of a feature's rows.  Scores come from whole counts, so the
tree does not depend on the partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnwise.operators.model import FEATURE_VECTOR, encode_features
from churnwise.schemas import TreeParams
from churnwise.session import finished, kept, scratch_path

EDGE_ACCURACY = 10000  # of the approximate quantiles that cut the bins; bins only decide what is tried when
MARGIN = 1e-12  # a bin stays if rounding alone keeps its bound below the best border


@dataclass
class Node:
    """A node of the tree: its rows per class and, unless it is a leaf, its split and children."""

    zeros: int
    ones: int
    feature: int = -1
    threshold: float = 0.0
    left: int = -1
    right: int = -1


def doubles(values) -> Column:
    """One constant array of doubles."""
    return F.expr("array(" + ",".join(f"double('{float(v)!r}')" for v in values) + ")")


def longs(values) -> Column:
    """One constant array of integers."""
    return F.expr("array(" + ",".join(str(int(v)) for v in values) + ")")


def _gain_side(zeros: Column, ones: Column, weights: tuple[float, float]) -> Column:
    one = ones * F.lit(weights[1])
    total = zeros * F.lit(weights[0]) + one
    return F.when(total > 0, one * one / total).otherwise(F.lit(0.0))


def _split_score(left: tuple[Column, Column], total: tuple[Column, Column], weights) -> Column:
    """Squared weight of ones over weight, left plus right: the larger, the less impurity is left."""
    return _gain_side(*left, weights) + _gain_side(total[0] - left[0], total[1] - left[1], weights)


def _threshold(value: Column, following: Column) -> Column:
    """The midpoint, or the smaller value where the midpoint is not below the greater one (neighbours
    without a double between them, infinities, NaN); values up to it go left."""
    middle = (value + following) / 2
    return F.when(middle < following, middle).otherwise(value)


def _allowed(left_rows: Column, rows: Column, min_leaf: int) -> Column:
    return (left_rows >= min_leaf) & (rows - left_rows >= min_leaf)


def _node_of(nodes: list[Node], depth: int) -> Column:
    """The node that a row has reached after ``depth`` steps from the root."""
    feature, threshold = longs(n.feature for n in nodes), doubles(n.threshold for n in nodes)
    left, right = longs(n.left for n in nodes), longs(n.right for n in nodes)

    def step(at, _):
        value = F.get("_x", F.get(feature, at))
        return F.when(F.get(feature, at) < 0, at).when(value <= F.get(threshold, at), F.get(left, at)).otherwise(
            F.get(right, at))
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step) if depth else F.lit(0)


def _binned(data: DataFrame, features: list[str], bins: int) -> DataFrame:
    """Rows as ``_x`` (values), ``_b`` (bin of each value) and ``_y``."""
    shares = [(i + 1) / bins for i in range(bins - 1)]
    found = data.agg(*[F.percentile_approx(f, shares, EDGE_ACCURACY).alias(f) for f in features]).first()
    infinite = float("inf")
    edges = [sorted({v + 0.0 for v in found[f] or [] if abs(v) < infinite}) or [0.0] for f in features]
    cut = Bucketizer(splitsArray=[[-infinite, *e, infinite] for e in edges], inputCols=features,
                     outputCols=[f"_bin{i}" for i in range(len(features))], handleInvalid="keep").transform(data)
    return cut.select(F.array(*features).alias("_x"),
                      F.array(*[F.col(f"_bin{i}").cast("int") for i in range(len(features))]).alias("_b"), "_y")


def _cells(values: DataFrame, weights, min_leaf: int) -> DataFrame:
    """Per (node, feature, bin): counts in it and before it, the score of its upper border, and whether a split
    inside it may be better than every border of the node."""
    counts = values.groupBy("node", "f", "bin").agg(
        F.count_if(F.col("_y") == 0).alias("n0"), F.count_if(F.col("_y") == 1).alias("n1"),
        F.min("v").alias("lo"), F.max("v").alias("hi"))
    feature = Window.partitionBy("node", "f")
    before = feature.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.withColumns({
        "p0": F.coalesce(F.sum("n0").over(before), F.lit(0)), "p1": F.coalesce(F.sum("n1").over(before), F.lit(0)),
        "t0": F.sum("n0").over(feature), "t1": F.sum("n1").over(feature),
        "following": F.lead("lo").over(feature.orderBy("bin"))})
    p0, p1, n0, n1, t0, t1 = (F.col(c) for c in ("p0", "p1", "n0", "n1", "t0", "t1"))
    border = F.when(F.col("following").isNotNull() & _allowed(p0 + n0 + p1 + n1, t0 + t1, min_leaf),
                    _split_score((p0 + n0, p1 + n1), (t0, t1), weights))
    corners = [_split_score((p0 + a, p1 + b), (t0, t1), weights) for a in (F.lit(0), n0) for b in (F.lit(0), n1)]
    # a split inside leaves one of the bin's rows at least on either side
    room = (p0 + p1 + n0 + n1 - 1 >= min_leaf) & (t0 + t1 - p0 - p1 - 1 >= min_leaf)
    best = F.max("border").over(Window.partitionBy("node"))  # at most features x bins rows a node
    return cells.withColumns({"border": border, "bound": F.greatest(*corners)}).withColumn(
        "inside", (F.col("lo") < F.col("hi")) & room & (best.isNull() | (F.col("bound") >= best * (1 - MARGIN))))


def _inner_splits(values: DataFrame, cells: DataFrame, weights, min_leaf: int) -> DataFrame:
    """Every split between neighbouring values within the bins that are left."""
    wanted = cells.where("inside").select("node", "f", "bin", "p0", "p1", "t0", "t1")
    counted = values.join(wanted, ["node", "f", "bin"]).groupBy("node", "f", "bin", "v").agg(
        F.count_if(F.col("_y") == 0).alias("n0"), F.count_if(F.col("_y") == 1).alias("n1"),
        *[F.first(c).alias(c) for c in ("p0", "p1", "t0", "t1")])
    order = Window.partitionBy("node", "f", "bin").orderBy("v")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tried = counted.withColumns({"l0": F.col("p0") + F.sum("n0").over(upto), "l1": F.col("p1") + F.sum("n1").over(upto),
                                 "following": F.lead("v").over(order)}).where("following IS NOT NULL")
    total = F.col("t0"), F.col("t1")
    return tried.where(_allowed(F.col("l0") + F.col("l1"), total[0] + total[1], min_leaf)).select(
        "node", "f", _threshold(F.col("v"), F.col("following")).alias("threshold"), "l0", "l1",
        _split_score((F.col("l0"), F.col("l1")), total, weights).alias("score"))


def _best_splits(values: DataFrame, weights, min_leaf: int) -> dict:
    """node -> (feature, threshold, zeros left, ones left); ties go to the first feature, then the smallest threshold."""
    cells = finished(_cells(values, weights, min_leaf))
    borders = cells.where("border IS NOT NULL").select(
        "node", "f", _threshold(F.col("hi"), F.col("following")).alias("threshold"),
        (F.col("p0") + F.col("n0")).alias("l0"), (F.col("p1") + F.col("n1")).alias("l1"), F.col("border").alias("score"))
    every = borders.unionByName(_inner_splits(values, cells, weights, min_leaf))
    best = every.groupBy("node").agg(F.max(F.struct("score", (-F.col("f")).alias("f"), (-F.col("threshold")).alias("t"),
                                                    "l0", "l1")).alias("s"))
    return {r["node"]: (-r["s"]["f"], -r["s"]["t"] + 0.0, r["s"]["l0"], r["s"]["l1"]) for r in best.collect()}


def grow(data: DataFrame, features: list[str], max_depth: int, min_leaf: int, min_split: int = 2,
         balanced: bool = True, bins: int = 256) -> tuple[list[Node], tuple[float, float]]:
    """Nodes in level order and the weights of class 0 and 1, from non-null double ``features`` and a 0/1 ``_y``.

    A node is split while it is above ``max_depth``, holds both classes and at least ``min_split`` rows, and some split
    leaves ``min_leaf`` rows on both sides, also one that gains nothing by itself.  No rows: ``ValueError``."""
    with kept(_binned(data, features, bins)) as (rows,):
        n = rows.agg(F.count_if(F.col("_y") == 0), F.count_if(F.col("_y") == 1)).first()
        if not sum(n):
            raise ValueError("no labelled rows to grow a tree from")
        weights = tuple(sum(n) / (sum(c > 0 for c in n) * c) if balanced and c else 1.0 for c in n)
        nodes, level = [Node(*n)], [0]
        for depth in range(max_depth):
            level = [i for i in level if nodes[i].zeros and nodes[i].ones
                     and nodes[i].zeros + nodes[i].ones >= max(min_split, 2 * min_leaf)]
            if not level:
                break
            is_open = longs(int(i in set(level)) for i in range(len(nodes)))
            at = rows.withColumn("node", _node_of(nodes, depth)).where(F.get(is_open, F.col("node")) == 1)
            values = at.select("node", "_y", F.posexplode(F.arrays_zip("_x", "_b")).alias("f", "c")).select(
                "node", "_y", "f", F.col("c._x").alias("v"), F.col("c._b").alias("bin"))
            grown = []
            for i, (f, t, l0, l1) in sorted(_best_splits(values, weights, min_leaf).items()):
                node = nodes[i]
                node.feature, node.threshold, node.left, node.right = f, t, len(nodes), len(nodes) + 1
                nodes += [Node(l0, l1), Node(node.zeros - l0, node.ones - l1)]
                grown += [node.left, node.right]
            level = grown
        return nodes, weights


def _as_model(spark: SparkSession, nodes: list[Node], weights, features: list[str]) -> PipelineModel:
    """The nodes as a fitted Spark ML regression tree, through the node table of a saved model."""
    assembler = VectorAssembler(inputCols=features, outputCol=FEATURE_VECTOR)
    some = spark.range(2).select("id", *[F.lit(0.0).alias(f) for f in features]).withColumn("_label", F.lit(0.0))
    path = scratch_path(spark, "exact-tree")
    DecisionTreeRegressor(featuresCol=FEATURE_VECTOR, labelCol="_label", predictionCol="_p", maxDepth=0).fit(
        assembler.transform(some)).write().save(path)

    def weight(n):
        return n.zeros * weights[0] + n.ones * weights[1]

    def impurity(n):
        p = n.ones * weights[1] / weight(n)
        return p * (1 - p)

    table = []
    for i, n in enumerate(nodes):
        w, one = weight(n), n.ones * weights[1]
        gain, split = -1.0, (-1, [], -1)
        if n.left >= 0:
            a, b = nodes[n.left], nodes[n.right]
            gain = max(0.0, impurity(n) - (weight(a) * impurity(a) + weight(b) * impurity(b)) / w)
            split = (n.feature, [n.threshold], -1)
        table.append({"id": i, "prediction": one / w, "impurity": impurity(n), "impurityStats": [w, one, one],
                      "rawCount": n.zeros + n.ones, "gain": gain, "leftChild": n.left, "rightChild": n.right,
                      "split": dict(zip(("featureIndex", "leftCategoriesOrThreshold", "numCategories"), split))})
    schema = spark.read.parquet(f"{path}/data").schema
    spark.createDataFrame([tuple(r[f.name] if f.name != "split" else tuple(r["split"][g.name] for g in f.dataType)
                                 for f in schema) for r in table], schema).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/data")
    return PipelineModel(stages=[assembler, DecisionTreeRegressionModel.load(path)])


def _labelled(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    return encode_features(df, features).withColumn("_y", F.col(label).cast("int")).where("_y IN (0, 1)").select(
        *[(F.col(f) + F.lit(0.0)).alias(f) for f in features], "_y")  # -0.0 and 0.0 are one value


def train_exact_tree(df: DataFrame, label: str = "churn", params: TreeParams = TreeParams(), min_split: int = 20,
                     bins: int = 256) -> PipelineModel:
    """Like ``model.train_tree`` with exact thresholds and a least number of rows per split; what it returns scores,
    saves and explains in the same way.

    Rows whose label is neither 0 nor 1 are left out; a missing feature counts as 0, NaN as greater than any number.
    ``bins`` (at least 2) changes what a pass hands on, not the tree."""
    features = list(params.features)
    nodes, weights = grow(_labelled(df, label, features), features, params.max_depth, params.min_leaf, min_split,
                          params.balanced, bins)
    return _as_model(df.sparkSession, nodes, weights, features)


def exact_splits(df: DataFrame, label: str = "churn", params: TreeParams = TreeParams(), min_split: int = 20,
                 bins: int = 256) -> DataFrame:
    """The tree as a table: a row per node in level order with its rows per class and, unless it is a leaf, its
    feature, threshold (values up to it go left) and children."""
    features = list(params.features)
    nodes, _ = grow(_labelled(df, label, features), features, params.max_depth, params.min_leaf, min_split,
                    params.balanced, bins)
    table = [(i, n.zeros, n.ones, *((features[n.feature], n.threshold, n.left, n.right) if n.left >= 0 else [None] * 4))
             for i, n in enumerate(nodes)]
    return df.sparkSession.createDataFrame(
        table, "node int, zeros long, ones long, feature string, threshold double, left int, right int")
