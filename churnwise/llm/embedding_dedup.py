"""Embedding near-duplicates by product quantisation: inverted lists, residual codes,
asymmetric distances, exact cosine rerank."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnwise.llm.common import connected_components, local_roots, matrix, usable_vector, written

LIST_ROWS = 256  # vectors of one label in a list, on average, while the lists stay under MOST_LISTS
MOST_LISTS = 4096
SAMPLE_PER_LIST, LEAST_SAMPLE = 16, 4096  # vectors the centroids and codebooks are fitted on (bounded)
SUB_DIM, SUB_CODES = 4, 16  # components of a subspace and centroids of its codebook
BLOCK_ROWS = 2048  # members, and asking vectors, of a list that meet in one task group
SLACK = 1e-9


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Lloyd's centroids of a bounded sample; ``k`` distinct sample points to start with."""
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = nearest_centroid(x, c)
        size = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return c


def nearest_centroid(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([(half - x[i:i + 4096] @ c.T).argmin(1) for i in range(0, len(x), 4096)] or [
        np.empty(0, np.intp)])


@dataclass(frozen=True)
class Quantiser:
    """Coarse centroids and one codebook per subspace of the residuals, for unit vectors."""

    centroids: np.ndarray
    books: list[np.ndarray]

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[..., i:i + SUB_DIM] for i in range(0, x.shape[-1], SUB_DIM)]

    def lists(self, x: np.ndarray) -> np.ndarray:
        return nearest_centroid(x, self.centroids)

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals and the length of what the codes leave out."""
        parts = self.parts(x - self.centroids[own])
        codes = np.stack([nearest_centroid(p, b) for p, b in zip(parts, self.books)], axis=1).astype(np.uint8)
        left = sum(((p - b[codes[:, m]]) ** 2).sum(1) for m, (p, b) in enumerate(zip(parts, self.books)))
        return codes, np.sqrt(left)

    def probes(self, x: np.ndarray, own: np.ndarray, radius: float) -> np.ndarray:
        """Which lists can hold a vector within ``radius``: those whose bisecting plane
        with the own list is no further away than that."""
        square = (self.centroids ** 2).sum(1)[None, :] - 2 * x @ self.centroids.T
        apart = np.empty(square.shape)
        for o in np.unique(own):  # one list at a time: lists x dim numbers, not rows x lists x dim
            apart[own == o] = np.linalg.norm(self.centroids - self.centroids[o], axis=1)
        return square - square[np.arange(len(x)), own][:, None] <= 2 * radius * apart + SLACK

    def distances(self, x: np.ndarray, of: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances from vectors to the coded members of one list, by table lookup."""
        parts = self.parts(x - self.centroids[of])
        total = np.zeros((len(x), len(codes)))
        for m, (p, b) in enumerate(zip(parts, self.books)):
            lookup = ((p[:, None, :] - b[None, :, :]) ** 2).sum(2)
            total += lookup[:, codes[:, m]]
        return np.sqrt(np.maximum(total, 0))


def fit(sample: np.ndarray, lists: int, seed: int = 42) -> Quantiser:
    rng = np.random.default_rng(seed)
    centroids = kmeans(sample, lists, rng)
    residual = sample - centroids[nearest_centroid(sample, centroids)]
    books = [kmeans(residual[:, i:i + SUB_DIM], SUB_CODES, rng) for i in range(0, sample.shape[1], SUB_DIM)]
    return Quantiser(centroids, books)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def link(rows: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
         label_col: str = "label") -> DataFrame:
    """(id, n_links, component) per row: vectors of one label link at a cosine of at least ``threshold``.

    ``n_links`` counts the other vectors linked directly and ``component`` is the smallest
    id reachable.  A null label, id or vector, a zero vector and one with null or
    non-finite components link with nothing: no links, their own id.  Vectors are only
    compared with vectors of their length; a repeated id is one node that has the links of
    all its rows.

    Equal vectors of one label are folded into one class first.  Each class asks every
    list that can hold a vector within the threshold (see ``Quantiser.probes``), and the
    asymmetric distance less the member's coding error, a lower bound of the true
    distance, leaves out members that are too far; so no pair is lost, and every pair
    kept is verified by the cosine of the original vectors in double precision.  The
    members and askers of a list meet in blocks, and a block hands on a count and one root
    per vector, not its pairs.
    """
    ids = rows.schema[id_col].dataType
    base = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vec"),
                       F.size(vector_col).alias("dim"))
    ok = F.col("id").isNotNull() & F.col("label").isNotNull() & usable_vector(F.col("vec"))
    good = base.where(ok)
    classes = written(good.groupBy("label", "vec").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"))
                      .select("label", "vec", "low", "copies", F.size("vec").alias("dim")))
    radius = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    found = None
    for row in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n"),
                                          F.approx_count_distinct("label").alias("labels")).collect():
        part = _links(classes.where(F.col("dim") == row["dim"]).drop("dim"), row["n"], row["labels"], threshold,
                      radius, ids)
        found = part if found is None else found.unionByName(part)
    alone = base.where(~F.coalesce(ok, F.lit(False))).select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    if found is None:
        return alone
    found = written(found)  # at most a row per class and block
    roots = connected_components(found.select(F.col("id").alias("src"), F.col("root").alias("dst")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    per_class = (classes.join(counts, classes.low == counts.id, "left").drop("id")
                 .join(roots, F.col("low") == F.col("node"), "left")
                 .select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                         F.coalesce("root", "low").alias("component")))
    linked = good.join(per_class, ["label", "vec"]).select("id", "n_links", "component")
    return linked.unionByName(alone)


def _links(classes: DataFrame, n: int, labels: int, threshold: float, radius: float, ids: T.DataType) -> DataFrame:
    """(id, links, root) rows of the classes of one vector length."""
    lists = int(min(MOST_LISTS, max(1, n // (LIST_ROWS * max(1, labels)))))
    wanted = SAMPLE_PER_LIST * lists + LEAST_SAMPLE
    draw = F.pmod(F.xxhash64(F.lit("sample"), "low"), F.lit(1 << 20)) / float(1 << 20)
    taken = classes.where(draw < min(1.0, wanted / n)).select("vec").toArrow()
    if not len(taken):
        taken = classes.select("vec").limit(1).toArrow()
    quantiser = fit(unit(matrix(taken.column("vec"))), lists)

    @F.arrow_udf(T.StructType([T.StructField("list", T.IntegerType()), T.StructField("codes", T.BinaryType()),
                               T.StructField("error", T.DoubleType()),
                               T.StructField("probes", T.ArrayType(T.IntegerType()))]))
    def indexed(vectors: pa.Array) -> pa.Array:
        x = unit(matrix(vectors))
        own = quantiser.lists(x)
        codes, error = quantiser.encode(x, own)
        probes = [np.flatnonzero(p).astype(np.int32) for i in range(0, len(x), 256)
                  for p in quantiser.probes(x[i:i + 256], own[i:i + 256], radius)]
        return pa.StructArray.from_arrays(
            [pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error),
             pa.array(probes, pa.list_(pa.int32()))], ["list", "codes", "error", "probes"])

    index = written(classes.select("label", "vec", "low", "copies", indexed(F.col("vec")).alias("q"))
                    .select("label", "vec", "low", "copies", "q.*"))
    members = index.select("label", "list", "low", "copies", "codes", "error", "vec")
    # fresh names for the second reading of the same table
    asking = index.select(F.explode("probes").alias("list"), *[F.col(c).alias(c) for c in ("label", "low", "vec")])

    # blocks of each side of a list: (label, list) rows, at most MOST_LISTS per label
    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("label", "list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias(name))

    grid = written(blocks(members, "m_blocks").join(blocks(asking, "a_blocks"), ["label", "list"]), labels * lists)

    def dealt(df: DataFrame, mine: str, other: str, mine_name: str, other_name: str) -> DataFrame:
        return (df.join(grid, ["label", "list"])
                .withColumn(mine_name, F.pmod(F.xxhash64("low"), F.col(mine)).cast("int"))
                .withColumn(other_name, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
                .drop("m_blocks", "a_blocks"))

    key = ["label", "list", "mb", "ab"]
    left = dealt(members, "m_blocks", "a_blocks", "mb", "ab")
    right = dealt(asking, "a_blocks", "m_blocks", "ab", "mb")
    schema = T.StructType([T.StructField("id", ids), T.StructField("links", T.LongType()), T.StructField("root", ids)])

    def compared(have: pa.Table, ask: pa.Table) -> pa.Table:
        kind = have.schema.field("low").type
        none = pa.table({"id": pa.array([], kind), "links": pa.array([], pa.int64()), "root": pa.array([], kind)})
        if not len(have) or not len(ask):
            return none
        of = have.column("list")[0].as_py()
        hx, ax = unit(matrix(have.column("vec"))), unit(matrix(ask.column("vec")))
        hid, aid = have.column("low").to_numpy(), ask.column("low").to_numpy()
        copies = have.column("copies").to_numpy()
        codes = np.array([np.frombuffer(c, np.uint8) for c in have.column("codes").to_pylist()])
        error = have.column("error").to_numpy()
        a, h = [], []
        for i in range(0, len(ax), 256):
            near = quantiser.distances(ax[i:i + 256], of, codes) - error[None, :] <= radius + SLACK
            s, t = np.nonzero(near)
            for j in range(0, len(s), 1 << 16):
                sj, tj = s[j:j + (1 << 16)] + i, t[j:j + (1 << 16)]
                same = np.einsum("ij,ij->i", ax[sj], hx[tj])
                yes = (same >= threshold) & (aid[sj] != hid[tj])
                a.append(sj[yes])
                h.append(tj[yes])
        a, h = np.concatenate(a or [np.empty(0, int)]).astype(int), np.concatenate(h or [np.empty(0, int)]).astype(int)
        if not len(a):
            return none
        links = np.bincount(a, weights=copies[h], minlength=len(aid)).astype(np.int64)
        nodes, roots = local_roots(aid[a], hid[h])
        count = dict(zip(aid.tolist(), links.tolist()))
        return pa.table({"id": pa.array(nodes, kind), "links": pa.array([count.get(v, 0) for v in nodes.tolist()],
                                                                        pa.int64()), "root": pa.array(roots, kind)})

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compared, schema)
