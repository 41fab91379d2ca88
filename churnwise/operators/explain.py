"""Tree attributions (F14): exact path-dependent TreeSHAP on the fitted tree.

The tree (at most 2^(depth+1) - 1 nodes) is read from the model's saved node
table in the shared checkpoint folder and shipped to every task inside the
``mapInPandas`` closure; rows stay on their executors.  The algorithm is the
path-dependent TreeSHAP of Lundberg, Erion and Lee (2018, "Consistent
individualized feature attribution for tree ensembles", Algorithm 2).  Its
recursion visits every node for every row; only the "one fractions" (does
this row follow the branch) depend on the row, so the whole recursion runs
once per Arrow batch on numpy vectors of batch length.

Node covers are the weighted training counts, so with class weights the
attributions add up exactly: base value + sum of SHAP values = prediction.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnwise.operators.model import encode_features, feature_names
from churnwise.session import scratch_path


def tree_nodes(model: PipelineModel, spark) -> dict:
    """Node arrays of the fitted tree: children, split feature and threshold,
    cover (weighted count) and leaf value, indexed by node id."""
    path = scratch_path(spark, "tree")
    model.stages[-1].write().overwrite().save(path)
    rows = (spark.read.parquet(f"{path}/data")
            .select("id", "prediction", F.col("impurityStats")[0].alias("cover"), "leftChild", "rightChild",
                    F.col("split.featureIndex").alias("feature"),
                    F.col("split.leftCategoriesOrThreshold").alias("thr"),
                    F.col("split.numCategories").alias("ncat"))
            .orderBy("id").collect())
    n = len(rows)
    out = {k: np.zeros(n, dtype=t) for k, t in
           (("left", np.int64), ("right", np.int64), ("feature", np.int64), ("threshold", np.float64),
            ("cover", np.float64), ("value", np.float64))}
    for r in rows:
        i = r["id"]
        if r["leftChild"] >= 0 and r["ncat"] not in (-1, None):
            raise ValueError("categorical splits are not supported")
        out["left"][i], out["right"][i] = r["leftChild"], r["rightChild"]
        out["feature"][i] = r["feature"]
        out["threshold"][i] = r["thr"][0] if r["thr"] else np.nan
        out["cover"][i], out["value"][i] = r["cover"], r["prediction"]
    return out


def _extend(path, z, o, d):
    """Add a split (feature d, zero fraction z, per-row one fraction o)."""
    ln = len(path)
    path = [list(e) for e in path]
    path.append([d, z, o, np.ones_like(o) if ln == 0 else np.zeros_like(o)])
    for i in range(ln - 1, -1, -1):
        path[i + 1][3] = path[i + 1][3] + o * path[i][3] * ((i + 1) / (ln + 1))
        path[i][3] = z * path[i][3] * ((ln - i) / (ln + 1))
    return path


def _unwind(path, k):
    """Undo the extension of element k (inverse of _extend), per row."""
    ln = len(path) - 1
    z, o = path[k][1], path[k][2]
    nxt = path[ln][3].copy()
    out = [list(e) for e in path[:ln]]
    has = o != 0
    safe_o = np.where(has, o, 1.0)
    for j in range(ln - 1, -1, -1):
        w = out[j][3]
        w_one = nxt * (ln + 1) / ((j + 1) * safe_o)
        w_zero = (w * (ln + 1) / (z * (ln - j))) if z != 0 else np.zeros_like(w)
        new_w = np.where(has, w_one, w_zero)
        nxt = np.where(has, w - new_w * z * ((ln - j) / (ln + 1)), nxt)
        out[j][3] = new_w
    for j in range(k, ln):
        out[j][0], out[j][1], out[j][2] = path[j + 1][0], path[j + 1][1], path[j + 1][2]
    return out


def tree_shap(nodes: dict, x: np.ndarray) -> tuple[np.ndarray, float]:
    """SHAP values (rows x features) and the base value for feature matrix x."""
    n, m = x.shape
    phi = np.zeros((n, m))
    left, right, feat, thr = nodes["left"], nodes["right"], nodes["feature"], nodes["threshold"]
    cover, value = nodes["cover"], nodes["value"]

    def recurse(j, path, z, o, d):
        path = _extend(path, z, o, d)
        if left[j] < 0:
            for i in range(1, len(path)):
                w = sum(e[3] for e in _unwind(path, i))
                phi[:, path[i][0]] += w * (path[i][2] - path[i][1]) * value[j]
            return
        goes_left = (x[:, feat[j]] <= thr[j]).astype(np.float64)
        iz, io = 1.0, np.ones(n)
        k = next((i for i in range(1, len(path)) if path[i][0] == feat[j]), None)
        if k is not None:
            iz, io = path[k][1], path[k][2]
            path = _unwind(path, k)
        for child, go in ((left[j], goes_left), (right[j], 1.0 - goes_left)):
            recurse(child, path, iz * cover[child] / cover[j], io * go, feat[j])

    recurse(0, [], 1.0, np.ones(n), -1)
    leaves = left < 0
    base = float(np.sum(value[leaves] * cover[leaves]) / cover[0])
    return phi, base


def shap_values(model: PipelineModel, df: DataFrame, key: str = "customer_id") -> DataFrame:
    """Per row: key, base value, model prediction and one ``shap_<feature>``
    column per feature (wide, so a row is one Arrow record)."""
    spark = df.sparkSession
    names = feature_names(model)
    nodes = tree_nodes(model, spark)
    enc = encode_features(df, names).select(key, *names)
    key_type = enc.schema[key].dataType.simpleString()
    schema = (f"{key} {key_type}, base_value double, prediction double, "
              + ", ".join(f"shap_{f} double" for f in names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            x = b[names].to_numpy(dtype=np.float64)
            phi, base = tree_shap(nodes, x)
            out = pd.DataFrame(phi, columns=[f"shap_{f}" for f in names])
            out.insert(0, "prediction", base + phi.sum(axis=1))
            out.insert(0, "base_value", base)
            out.insert(0, key, b[key].to_numpy())
            yield out

    return enc.mapInPandas(run, schema)


def _leaf_paths(nodes: dict, features: int) -> list[dict]:
    """Per leaf its value and, per feature, the interval (lo, hi] that leads to it and the share of the cover that
    takes its branches; a feature that is not on the path has neither bound and share 1."""
    out = []

    def walk(j, lo, hi, z):
        if nodes["left"][j] < 0:
            out.append({"v": float(nodes["value"][j]), "lo": lo, "hi": hi, "z": z})
            return
        f, t = int(nodes["feature"][j]), float(nodes["threshold"][j])
        for child, low, high in ((nodes["left"][j], None, t), (nodes["right"][j], t, None)):
            a, b, c = list(lo), list(hi), list(z)
            if low is not None:
                a[f] = low if a[f] is None else max(a[f], low)
            if high is not None:
                b[f] = high if b[f] is None else min(b[f], high)
            c[f] *= float(nodes["cover"][child] / nodes["cover"][j])
            walk(int(child), a, b, c)

    walk(0, [None] * features, [None] * features, [1.0] * features)
    return out


def shap_expressions(model: PipelineModel, df: DataFrame, key: str = "customer_id") -> DataFrame:
    """The result of ``shap_values`` from JVM expressions alone, for sessions without Python on the executors.

    A leaf of value v gives feature i the sum over the subsets S of the path's other features of
    |S|! (m - |S| - 1)! / m! times the product of o (in S) and z (not in S), times v (o_i - z_i).  Since
    s! (k - s)! / (k + 1)! is the integral of t^s (1 - t)^(k - s) over 0..1, that sum is the integral of the product of
    o_j t + z_j (1 - t): a polynomial of degree m - 1, which m / 2 Gauss-Legendre points integrate exactly.
    Work per row: leaves x features x points; the leaves are one constant."""
    names = feature_names(model)
    nodes = tree_nodes(model, df.sparkSession)
    paths = _leaf_paths(nodes, len(names))
    longest = max([1, *(sum(a is not None or b is not None for a, b in zip(p["lo"], p["hi"])) for p in paths)])
    at, weight = np.polynomial.legendre.leggauss((longest + 1) // 2)
    points = [((float(t) + 1) / 2, float(w) / 2) for t, w in zip(at, weight)]
    leaves = F.from_json(F.lit(json.dumps(paths)),
                         "array<struct<v: double, lo: array<double>, hi: array<double>, z: array<double>>>")

    def mixed(o, z, t):
        return o * t + z * (1 - t)

    def follows(leaf):
        inside = lambda x, i: (F.coalesce(x > leaf["lo"][i], F.lit(True))
                               & F.coalesce(x <= leaf["hi"][i], F.lit(True))).cast("double")
        return F.transform("_x", inside)

    def product(o, z, t):
        return F.aggregate(F.zip_with(o, z, lambda a, b: mixed(a, b, F.lit(t))), F.lit(1.0), lambda p, f: p * f)

    def add(total, leaf):
        row = F.transform(F.array(follows(leaf)), lambda o: F.struct(
            o.alias("o"), F.array(*[product(o, leaf["z"], t) for t, _ in points]).alias("p")))[0]

        def one(r):
            def part(s, i):
                o, z = r["o"][i], leaf["z"][i]
                others = sum((w * r["p"][q] / mixed(o, z, F.lit(t)) for q, (t, w) in enumerate(points)), F.lit(0.0))
                return F.when(o == z, s).otherwise(s + leaf["v"] * (o - z) * others)
            return F.transform(total, part)
        return F.transform(F.array(row), one)[0]

    base = float(sum(p["v"] * np.prod(p["z"]) for p in paths))
    phi = F.aggregate(leaves, F.array(*[F.lit(0.0)] * len(names)), add)
    enc = encode_features(df, names).select(F.col(key), F.array(*names).alias("_x"))
    found = enc.select(key, phi.alias("_phi"))
    return found.select(key, F.lit(base).alias("base_value"),
                        F.aggregate("_phi", F.lit(base), lambda t, v: t + v).alias("prediction"),
                        *[F.col("_phi")[i].alias(f"shap_{f}") for i, f in enumerate(names)])


def shap_summary(shap: DataFrame, top: int = 10) -> DataFrame:
    """Mean absolute SHAP value per feature, largest first, at most ``top``."""
    cols = [c for c in shap.columns if c.startswith("shap_")]
    long = shap.select(F.inline(F.array(*[
        F.struct(F.lit(c[len("shap_"):]).alias("feature"), F.abs(F.col(c)).alias("abs_shap")) for c in cols])))
    return (long.groupBy("feature").agg(F.avg("abs_shap").alias("mean_abs_shap"))
            .orderBy(F.desc("mean_abs_shap"), F.asc("feature")).limit(top))
