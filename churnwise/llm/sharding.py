"""Sharding by a drawn communication matrix: a uniform shuffle with exact shard sizes."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnwise.llm.common import written

MATRIX_ENTRIES = 1 << 20  # partition-to-shard counts held by the driver at most
CELL_ROWS = 1000  # rows of one shard that are put in order together, on average


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` balls out of ``good + bad`` are good; by inversion over the
    support within twelve standard deviations of the mode, for populations of any size."""
    low, high = max(0, draws - bad), min(draws, good)
    if low >= high:
        return high
    n = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (n + 2)))
    spread = int(12 * math.sqrt(draws * (good / n) * (bad / n) * ((n - draws) / max(1, n - 1)))) + 40
    a, b = max(low, mode - spread), min(high, mode + spread)
    k = np.arange(a, b, dtype=np.float64)
    ratio = np.log((good - k) * (draws - k)) - np.log((k + 1) * (bad - draws + k + 1))
    weight = np.concatenate(([0.0], np.cumsum(ratio)))
    total = np.cumsum(np.exp(weight - weight.max()))
    return a + int(np.searchsorted(total, rng.random() * total[-1], side="right"))


def communication_matrix(counts: list[int], sizes: list[int], rng: np.random.Generator) -> list[list[int]]:
    """Rows to send from each partition to each shard, with both margins exact: one
    multivariate hypergeometric draw per partition from what the shards still take."""
    left, out = list(sizes), []
    for count in counts:
        row, draws, rest = [], count, sum(left)
        for size in left:
            rest -= size
            got = hypergeometric(rng, size, rest, draws)
            row.append(got)
            draws -= got
        left = [a - b for a, b in zip(left, row)]
        out.append(row)
    return out


def shard(df: DataFrame, shards: int = 24, seed: int = 42) -> DataFrame:
    """``df`` with ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 in each shard).

    Shard sizes differ by at most one row, and every arrangement of the rows is equally
    likely up to the quality of the hash that deals the random keys.

    1. Each input partition puts its rows in random order and is written, so that its
       row numbers stay valid whatever happens to an executor.
    2. From the partitions' row counts the driver draws the matrix of rows per partition
       and shard (at most ``MATRIX_ENTRIES`` numbers); a row's number in its partition
       then decides its shard.
    3. One exchange moves the rows, by shard and random cell, and each cell is permuted
       again; cells are numbered by a running sum over their counts.

    All columns are kept, whatever their names; columns named shard or slot are replaced.
    Null values and repeated rows are rows like any other; an empty table stays empty.
    """
    spark = df.sparkSession
    keep = [c for c in df.columns if c not in ("shard", "slot")]
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    in_part = F.lit((1 << 33) - 1)
    at = F.monotonically_increasing_id()
    local = written(
        df.coalesce(max(1, MATRIX_ENTRIES // shards)).select(row, at.alias("at"))
        .select("row", F.shiftright("at", 33).alias("block"), F.xxhash64(F.lit(seed), "at").alias("key"))
        .sortWithinPartitions("key")
        .select("row", "block", at.bitwiseAND(in_part).alias("rank")))

    counts = {r["block"]: r["count"] for r in local.groupBy("block").count().collect()}
    n, blocks = sum(counts.values()), sorted(counts)
    sizes = [n // shards + (s < n % shards) for s in range(shards)]
    drawn = communication_matrix([counts[b] for b in blocks], sizes, np.random.default_rng(seed))
    table = [{"block": b, "ends": np.cumsum(r).tolist()} for b, r in zip(blocks, drawn)]
    matrix = spark.range(1).select(F.explode(F.from_json(
        F.lit(json.dumps(table)), "array<struct<block: bigint, ends: array<bigint>>>")).alias("m")).select("m.*")

    cells = max(1, math.ceil(n / shards / CELL_ROWS))
    key = F.xxhash64(F.lit(seed + 1), "block", "rank")
    # the matrix has at most MATRIX_ENTRIES numbers (8 MB), a proven bound
    sent = local.join(F.broadcast(matrix), "block").select(
        "row", "block", "rank",
        F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard"),
        key.alias("key"), F.pmod(key, F.lit(cells)).alias("cell"))
    before = (Window.partitionBy("shard").orderBy("cell")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = sent.groupBy("shard", "cell").count().select(
        "shard", "cell", (F.sum("count").over(before) - F.col("count")).alias("first"))
    order = Window.partitionBy("shard", "cell").orderBy("key", "block", "rank")
    placed = sent.select("row", "shard", "cell", (F.row_number().over(order) - 1).alias("nth"))
    return placed.join(first, ["shard", "cell"]).select(
        "row.*", F.col("shard").cast("int").alias("shard"), (F.col("first") + F.col("nth")).alias("slot"))
