"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnwise.llm.common import matrix, runs, usable_vector, written

TABLES = 24  # with one rotation a bucket
MORE_TABLES = 8  # tables besides for every further rotation
CANDIDATES = 6000  # candidates a query is expected to see at least, which sets the probes of a table
LEAST_PROBES = 4  # at fewer, recall on 50,000 unrelated directions falls below 0.9
MORE_PROBES = 32  # times as many probes for every further rotation; chance to meet at cosine 0.5 stays above 0.99
CODES = 1024  # codes of a vector that are made at a time, at least those of one table
STEP_ROWS = 256  # rows that are coded at a time
BUCKET_ROWS = 1 << 16  # rows of a bucket on average at most; one rotation does up to millions of rows
BLOCK_ROWS = 4096  # indexed rows of one bucket that are searched together; larger buckets are split
PART_ROWS = 20_000  # indexed rows of one task group, on average
SPLIT_BROADCAST_ROWS = 100_000  # rows of the table of split buckets broadcast at most


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        y = x.reshape(len(x), n // (2 * step), 2, step)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        step *= 2
    return x


def lifted(x: np.ndarray, radius: float) -> np.ndarray:
    """Rows on the unit sphere by inverse stereographic projection, zero-padded to a power
    of two.  Vectors of length ``radius`` keep their mutual distances up to scale, so
    distances decide there and not only directions."""
    square = (x * x).sum(1, keepdims=True)
    up = np.concatenate((2 * radius * x, square - radius * radius), axis=1) / (square + radius * radius)
    width = 1 << max(1, math.ceil(math.log2(up.shape[1])))
    return np.pad(up, ((0, 0), (0, width - up.shape[1])))


def axes(x: np.ndarray, table: int, probes: int, hashes: int = 1, seed: int = 42) -> np.ndarray:
    """Codes of the ``probes`` nearest buckets of each row in a table, nearest first.

    Each of the table's ``hashes`` pseudo-rotations (three rounds of random signs and a
    Hadamard transform) takes a row to a signed axis; a bucket is a combination of them.
    A bucket is the nearer, the less its axes fall short of the nearest ones in sum.
    """
    if len(x) > STEP_ROWS:
        return np.concatenate([axes(x[i:i + STEP_ROWS], table, probes, hashes, seed)
                               for i in range(0, len(x), STEP_ROWS)])
    width = 2 * x.shape[1]
    code, loss = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for h in range(hashes):
        rng = np.random.default_rng([seed, table, h])
        y = x
        for _ in range(3):
            y = hadamard(y * rng.choice((-1.0, 1.0), size=y.shape[1]))
        both = np.concatenate((y, -y), axis=1)
        if probes == 1:
            best = both.argmax(1)[:, None]
        else:
            best = np.argsort(-both, axis=1, kind="stable")[:, :probes]
        short = both.max(1, keepdims=True) - np.take_along_axis(both, best, axis=1)
        # both are sorted: the pair (i, j) is no nearer than the (i + 1) * (j + 1) pairs up to it
        i, j = np.divmod(np.arange(code.shape[1] * best.shape[1]), best.shape[1])
        i, j = (at[(i + 1) * (j + 1) <= probes] for at in (i, j))
        total, codes = loss[:, i] + short[:, j], code[:, i] * width + best[:, j]
        keep = np.argsort(total, axis=1, kind="stable")[:, :probes]
        code, loss = np.take_along_axis(codes, keep, axis=1), np.take_along_axis(total, keep, axis=1)
    return code


def effort(n: int, buckets: int, candidates: int = CANDIDATES, hashes: int | None = None,
           tables: int | None = None) -> tuple[int, int, int]:
    """(hashes, tables, probes) for ``n`` rows; a rotation has ``buckets`` signed axes."""
    if hashes is None:
        hashes = max(1, math.ceil(math.log(max(1, n) / BUCKET_ROWS, buckets)))
    if tables is None:
        tables = TABLES + MORE_TABLES * (hashes - 1)
    wanted = math.ceil(candidates * buckets ** hashes / (tables * max(1, n)))
    return hashes, tables, min(buckets ** hashes, max(LEAST_PROBES * MORE_PROBES ** (hashes - 1), wanted))


def _codes(probes: int, tables: int, step: int, hashes: int, radius: float):
    """Arrow UDF: for each vector the codes of its probes in ``step`` tables from the given one on; the
    tables' codes do not overlap."""
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def codes(vectors: pa.Array, tables_from: pa.Array) -> pa.Array:
        size = np.array(vectors.value_lengths().to_numpy(zero_copy_only=False), int)
        first = tables_from.to_numpy(zero_copy_only=False)
        out: list = [None] * len(vectors)
        for n, low in np.unique(np.stack((size, first)), axis=1).T:
            rows = np.flatnonzero((size == n) & (first == low))
            x = lifted(matrix(vectors.take(pa.array(rows))), radius)
            found = np.concatenate([axes(x, t, probes, hashes) * tables + t
                                    for t in range(low, min(low + step, tables))], axis=1)
            for i, c in zip(rows, found):
                out[i] = c
        return pa.array(out, pa.list_(pa.int64()))
    return codes


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
            tables: int | None = None, candidates: int = CANDIDATES, hashes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every query, ties to smaller ids.

    ``rows`` are indexed, ``queries`` (same columns) are searched; a row is no candidate
    of the query with its own id.  ``score`` is the Euclidean distance of the original
    vectors in double precision.  Null, zero and non-finite vectors and null ids take no
    part, vectors are only compared with vectors of their length, and a row that repeats
    an id counts once, by its nearest copy.

    Every row is in one bucket of each table; a query looks into its nearest buckets of each
    table, as many as make the expected number of candidates ``candidates``.  A bucket joins
    so many rotations (``hashes``) that it holds ``BUCKET_ROWS`` rows at most on average; as two
    near vectors then meet less often, tables and probes grow with the rotations.  The
    distances of a bucket are taken in a task group, which hands on its ``k`` best per
    query only; buckets above ``BLOCK_ROWS`` rows are split, and their queries go to
    every part.
    """
    def cleaned(df: DataFrame) -> DataFrame:
        # new names on both sides, also when the queries are rows of the index
        return df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec")).where(
            F.col("id").isNotNull() & usable_vector(F.col("vec")))

    data = cleaned(rows)
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    stats = data.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(square)).alias("radius"),
                     F.max(F.size("vec")).alias("dim")).first()
    n, radius = stats["n"], stats["radius"] or 1.0
    buckets = 2 << max(1, math.ceil(math.log2((stats["dim"] or 1) + 1)))
    hashes, tables, probes = effort(n, buckets, candidates, hashes, tables)

    def coded(df: DataFrame, count: int) -> DataFrame:
        step = max(1, CODES // count)
        code = _codes(count, tables, step, hashes, radius)(F.col("vec"), F.col("first"))
        return df.select("id", "vec", F.explode(F.array(*map(F.lit, range(0, tables, step)))).alias("first")).select(
            "id", "vec", F.explode(code).alias("code"), F.size("vec").alias("dim"))

    index = coded(data, 1)
    # at most tables * n / BLOCK_ROWS rows
    large = written(index.groupBy("code", "dim").count().where(F.col("count") > BLOCK_ROWS).select(
        "code", "dim", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks")), tables * n // BLOCK_ROWS)
    if large.count() <= SPLIT_BROADCAST_ROWS:
        large = F.broadcast(large)
    parts = max(1, n * tables // PART_ROWS)
    blocks = F.coalesce("blocks", F.lit(1))
    part = F.pmod(F.xxhash64("code", "dim", "block"), F.lit(parts)).cast("int").alias("part")
    left = index.join(large, ["code", "dim"], "left").select(
        "id", "vec", "code", "dim", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block")).select("*", part)
    right = coded(cleaned(queries), probes).join(large, ["code", "dim"], "left").select(
        "id", "vec", "code", "dim", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block")).select("*", part)

    id_type = rows.schema[id_col].dataType
    schema = T.StructType([T.StructField("query_id", id_type), T.StructField("vec_id", id_type),
                           T.StructField("score", T.DoubleType())])
    empty = [("query_id", []), ("vec_id", []), ("score", [])]

    def groups(t: pa.Table) -> tuple[np.ndarray, pa.Table]:
        key = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("code", "dim", "block")])
        order = np.lexsort(key)
        return key[:, order], t.take(pa.array(order))

    def searched(idx: pa.Table, ask: pa.Table) -> pa.Table:
        out_type = pa.schema([("query_id", idx.schema.field("id").type), ("vec_id", idx.schema.field("id").type),
                              ("score", pa.float64())])
        if not len(idx) or not len(ask):
            return pa.table({c: pa.array(v, out_type.field(c).type) for c, v in empty})
        ikey, idx = groups(idx)
        qkey, ask = groups(ask)
        where = {tuple(ikey[:, s]): (s, m) for s, m in zip(*runs_of(ikey))}
        asked, found, score = [], [], []
        iid, qid = idx.column("id").to_numpy(), ask.column("id").to_numpy()
        for s, m in zip(*runs_of(qkey)):
            hit = where.get(tuple(qkey[:, s]))
            if hit is None:
                continue
            x, ids = matrix(idx.column("vec").slice(*hit)), iid[hit[0]:hit[0] + hit[1]]
            q = matrix(ask.column("vec").slice(s, m))
            for j in range(m):
                d = np.sqrt(((x - q[j]) ** 2).sum(1))
                other = np.flatnonzero(ids != qid[s + j])
                if len(other) > k:
                    kth = np.partition(d[other], k - 1)[k - 1]
                    other = other[d[other] <= kth]
                best = other[np.lexsort((ids[other], d[other]))][:k]
                asked.append(np.repeat(qid[s + j], len(best)))
                found.append(ids[best])
                score.append(d[best])
        if not asked:
            return pa.table({c: pa.array(v, out_type.field(c).type) for c, v in empty})
        return pa.table({"query_id": pa.array(np.concatenate(asked), out_type.field("query_id").type),
                         "vec_id": pa.array(np.concatenate(found), out_type.field("vec_id").type),
                         "score": pa.array(np.concatenate(score))})

    best = left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(searched, schema)
    once = best.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(
        F.col("rank") <= k)


def runs_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal columns in a sorted key matrix."""
    change = np.concatenate(([0], np.cumsum((key[:, 1:] != key[:, :-1]).any(0))))
    return runs(change)
