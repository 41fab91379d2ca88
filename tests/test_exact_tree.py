"""The exact tree against exhaustive search, node by node."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnwise.operators import exact_tree, explain, model
from churnwise.schemas import TreeParams
from churnwise.session import checkpoint_dir
from churnwise.sources import io

NAMES = ["f0", "f1", "f2"]


def exhaustive(x, y, max_depth, min_leaf, min_split, weights):
    """The same tree by trying every midpoint of every feature in turn."""
    nodes = []

    def side(a, b):
        one = b * weights[1]
        total = a * weights[0] + one
        return one * one / total if total > 0 else 0.0

    queue = [(np.arange(len(y)), 0, None)]
    while queue:
        rows, depth, parent = queue.pop(0)
        here = len(nodes)
        n0, n1 = int((y[rows] == 0).sum()), int((y[rows] == 1).sum())
        nodes.append([-1, 0.0, n0, n1])
        if depth == max_depth or not n0 or not n1 or len(rows) < max(min_split, 2 * min_leaf):
            continue
        best = None
        for f in range(x.shape[1]):
            values = np.unique(x[rows, f])
            for a, b in zip(values, values[1:]):
                t = (a + b) / 2 if (a + b) / 2 < b else a
                left = rows[x[rows, f] <= t]
                if len(left) < min_leaf or len(rows) - len(left) < min_leaf:
                    continue
                l0, l1 = int((y[left] == 0).sum()), int((y[left] == 1).sum())
                key = (side(l0, l1) + side(n0 - l0, n1 - l1), -f, -t)
                if best is None or key > best[0]:
                    best = (key, f, t)
        if best is not None:
            _, f, t = best
            nodes[here][:2] = [f, t]
            goes = x[rows, f] <= t
            queue += [(rows[goes], depth + 1, here), (rows[~goes], depth + 1, here)]
    return nodes


def _table(spark, x, y):
    return spark.createDataFrame([(int(i), *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, y))],
                                 "customer_id long, f0 double, f1 double, f2 double, churn int").repartition(3)


def _made(case, n=300):
    r = np.random.default_rng(case)
    x = np.column_stack([r.normal(1e9, 1.0, n), r.integers(0, 4, n), np.round(r.exponential(10.0, n), 1)])
    y = ((x[:, 1] >= 2) ^ (x[:, 2] > 7.3) ^ (r.random(n) < 0.2)).astype(int)
    return x, y


@pytest.mark.parametrize("case,bins,min_leaf,min_split,balanced", [
    (1, 8, 1, 2, False), (2, 256, 10, 20, True), (3, 2, 3, 40, True)])
def test_equals_exhaustive_search(spark, case, bins, min_leaf, min_split, balanced):
    x, y = _made(case)
    nodes, weights = exact_tree.grow(_table(spark, x, y).withColumnRenamed("churn", "_y"), NAMES, 4, min_leaf,
                                     min_split, balanced, bins)
    assert weights == tuple((len(y) / (2 * (y == c).sum()) if balanced else 1.0) for c in (0, 1))
    want = exhaustive(x, y, 4, min_leaf, min_split, weights)
    assert [[n.feature, n.threshold, n.zeros, n.ones] for n in nodes] == want and len(want) > 5


def test_scores_saves_and_explains_like_any_tree(spark):
    x, y = _made(4)
    df = _table(spark, x, y)
    m = exact_tree.train_exact_tree(df, params=TreeParams(max_depth=4, min_leaf=5, features=tuple(NAMES)), min_split=30)
    weights = tuple(len(y) / (2 * (y == c).sum()) for c in (0, 1))
    want = exhaustive(x, y, 4, 5, 30, weights)
    children, following = {}, 1
    for i, n in enumerate(want):
        if n[0] >= 0:
            children[i], following = (following, following + 1), following + 2
    nodes, pairs = explain.tree_nodes(m, spark), [(0, 0)]
    while pairs:
        i, j = pairs.pop()
        feature, threshold, zeros, ones = want[i]
        cover = zeros * weights[0] + ones * weights[1]
        assert nodes["cover"][j] == pytest.approx(cover) and nodes["value"][j] == pytest.approx(ones * weights[1] / cover)
        assert (i in children) == (nodes["left"][j] >= 0)
        if i in children:
            assert (nodes["feature"][j], nodes["threshold"][j]) == (feature, threshold)
            pairs += [(children[i][0], nodes["left"][j]), (children[i][1], nodes["right"][j])]
    path = f"{checkpoint_dir(spark)}/exact-{uuid.uuid4().hex}"
    io.save_model(m, path)
    at = {r["customer_id"]: r["churn_probability"] for r in model.score(io.load_model(path), df).collect()}
    for i in range(len(y)):
        j = 0
        while j in children:
            j = children[j][0 if x[i, want[j][0]] <= want[j][1] else 1]
        one = want[j][3] * weights[1]
        assert at[i] == pytest.approx(one / (want[j][2] * weights[0] + one), abs=1e-12)
    assert sum(v for _, v in model.importances(m)) == pytest.approx(1.0)


def test_equal_values_nan_infinity_and_null_labels(spark):
    """One value: a leaf.  NaN is the greatest value, an infinite neighbour gives the smaller value as the threshold."""
    inf, nan = float("inf"), float("nan")
    same = spark.createDataFrame([(1.0, 0), (1.0, 1)] * 5, "f0 double, _y int")
    assert [n.left for n in exact_tree.grow(same, ["f0"], 3, 1)[0]] == [-1]
    odd = spark.createDataFrame([(5.0, 0), (5.0, 0), (nan, 1), (nan, 1)], "f0 double, _y int")
    assert exact_tree.grow(odd, ["f0"], 3, 1)[0][0].threshold == 5.0
    far = spark.createDataFrame([(-inf, 0), (inf, 1)], "f0 double, _y int")
    assert exact_tree.grow(far, ["f0"], 3, 1)[0][0].threshold == -inf
    zeros = spark.createDataFrame([(-0.0, 0, 1), (0.0, 1, 2), (-0.0, 1, 3), (0.0, 0, 4), (0.0, None, 5)],
                                  "f0 double, churn int, customer_id int")
    m = exact_tree.train_exact_tree(zeros, params=TreeParams(min_leaf=1, features=("f0",)), min_split=2)
    assert m.stages[-1].numNodes == 1
    with pytest.raises(ValueError, match="no labelled rows"):
        exact_tree.train_exact_tree(zeros.where("churn IS NULL"), params=TreeParams(features=("f0",)))


def test_few_rows_leave_the_first_pass(spark):
    """What the second pass reads is only the bins that may hold a better split."""
    rows = spark.range(20000).select(F.lit(0).alias("node"), F.lit(0).alias("f"), F.col("id").cast("double").alias("v"),
                                     (F.col("id") / 100).cast("int").alias("bin"),
                                     (F.col("id") > 12345).cast("int").alias("_y"))
    cells = exact_tree._cells(rows, (1.0, 1.0), 1)
    # the bin of the change, and the one whose upper border is the best border
    assert [r["bin"] for r in cells.where("inside").orderBy("bin").collect()] == [122, 123]
    assert exact_tree._best_splits(rows, (1.0, 1.0), 1) == {0: (0, 12345.5, 12346, 0)}
