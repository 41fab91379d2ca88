"""Mixing sources to target weights by Pfair scheduling of source blocks."""

from __future__ import annotations

import heapq
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnwise.llm.common import hash_bucket

PERIOD = 1000  # weights that are derived from counts are multiples of 1 / PERIOD of the weight they share
BLOCK_ROWS = 16  # documents in one block
BUCKET_ROWS = 2000  # documents of a source that are ranked together, on average
LEAST_SLOTS = 4  # slots of a period per source on average, at least
BUCKET_GROUP = 1000  # buckets whose sizes are added up together
MOST_SOURCES = 1 << 16  # sources of a mix, at most
MOST_BLOCKS = 1 << 18  # blocks of a mix, at most one per source more
TEMPER = 0.7  # power of its rows by which a source without a weight of its own shares the weight of REST
REST = "rest"


def slots_per_period(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Whole blocks of each source per period, by largest remainder; at least one each."""
    period = max(period, LEAST_SLOTS * len(weights))
    total = sum(weights.values())
    exact = {s: w * period / total for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (out[s] - exact[s], s))
    while sum(out.values()) < period:
        for s in order:
            if sum(out.values()) < period:
                out[s] += 1
    while sum(out.values()) > period:
        s = max(out, key=lambda s: (out[s] - exact[s] if out[s] > 1 else float("-inf"), s))
        out[s] -= 1
    return out


def pfair_schedule(share: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """One period of (source, block, release, deadline, slot).

    Block j of a source with weight w is released at floor(j / w) and due at
    ceil((j + 1) / w); each slot goes to the released block with the earliest deadline,
    ties to the source's name.  With weights that sum to one no deadline is missed, so
    after any number of slots every source is less than one block from its target.
    """
    period = sum(share.values())
    weight = {s: Fraction(a, period) for s, a in share.items()}
    waiting = sorted((int(j / weight[s]), s, j) for s, a in share.items() for j in range(a))
    ready, out, at = [], [], 0
    for slot in range(period):
        while at < len(waiting) and waiting[at][0] <= slot:
            release, s, j = waiting[at]
            heapq.heappush(ready, (-int(-(j + 1) / weight[s] // 1), s, j, release))
            at += 1
        deadline, s, j, release = heapq.heappop(ready)
        out.append((s, j, release, deadline, slot))
    return out


def own_weights(weights: dict[str, float], counts: dict[str, int]) -> dict[str, float]:
    """The weight of every source in ``counts``.

    Sources in ``weights`` have that one.  The others share the weight of ``"rest"`` in
    proportion to their rows to the power of ``TEMPER``, so that large sources give way to
    small ones; without that entry they share a trifle, and without any weights one.
    """
    others = [s for s in counts if s == REST or s not in weights]
    share = weights.get(REST, min(weights.values()) / 1e9 if weights else 1.0)
    total = sum(counts[s] ** TEMPER for s in others)
    return {s: share * counts[s] ** TEMPER / total if s in others else weights[s] for s in counts}


def target_weights(weights: dict[str, float], counts: dict[str, int]) -> dict[str, Fraction]:
    """The exact target weight of every source in ``counts``; they sum to one.

    A named weight is taken as it is written (0.3 is 3/10).  The others share the weight of ``"rest"``
    in the whole proportions of ``slots_per_period``.
    """
    if not counts:
        return {}
    others = [s for s in counts if s == REST or s not in weights]
    named = {s: Fraction(str(weights[s])) for s in counts if s not in others}
    given = Fraction(str(weights[REST])) if REST in weights else min(named.values()) / 10 ** 9 if named else Fraction(1)
    total = sum(named.values()) + (given if others else 0)
    out = {s: w / total for s, w in named.items()}
    if others:
        share = slots_per_period(own_weights({}, {s: counts[s] for s in others}))
        out |= {s: given / total * Fraction(n, sum(share.values())) for s, n in share.items()}
    return out


def schedule_blocks(target: dict[str, Fraction], blocks: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, block, release, deadline, slot) of every block, earliest deadline first.

    As in ``pfair_schedule``, but to the end of the last source and with windows straight from the exact
    weights: block j of weight w has the slots floor(j / w) to ceil((j + 1) / w).  Slots in which no block is
    released are left out, which happens only after a source has run out.
    """
    def window(s, j):
        w = target[s]
        return j * w.denominator // w.numerator, -(-(j + 1) * w.denominator // w.numerator)

    coming = [(0, window(s, 0)[1], s, 0) for s, n in blocks.items() if n]  # the next block of each source
    heapq.heapify(coming)
    ready, out, slot = [], [], 0
    while coming or ready:
        if not ready:
            slot = max(slot, coming[0][0])
        while coming and coming[0][0] <= slot:
            release, deadline, s, j = heapq.heappop(coming)
            heapq.heappush(ready, (deadline, s, j, release))
        deadline, s, j, release = heapq.heappop(ready)
        out.append((s, j, release, deadline, slot))
        if j + 1 < blocks[s]:
            after = window(s, j + 1)
            heapq.heappush(coming, (*after, s, j + 1))
        slot += 1
    return out


def mix(docs: DataFrame, weights: dict[str, float], source_col: str = "source", id_col: str = "doc_id",
        block_rows: int = BLOCK_ROWS, seed: int = 42, as_struct: bool = False) -> DataFrame:
    """``docs`` with mix_source, target, block, release, deadline, slot, place, on_target.

    ``weights`` names sources and their target weights; every other source that occurs
    gets a weight of its own by dividing that of ``"rest"`` (``target_weights``).  Rows
    without a source are the source ``"rest"``, as are those of a source of that name.  Every row
    is placed exactly once: the rows of a source, in random order, fill its blocks, and ``place`` (slot
    times block size plus the position in the block) orders the mix.  ``on_target`` holds for the rows
    before the first source runs out; up to there every prefix of whole slots has each source
    less than one block from its exact ``target``, and after it the remaining sources keep their
    proportions.  Sources named but absent are left out and the weights rescaled.

    The driver gets one count per source, of at most ``MOST_SOURCES`` (more raise), and schedules all
    blocks.  A block has ``block_rows`` rows, or as many more as keep the blocks at ``MOST_BLOCKS`` and
    one per source: that many rows of the schedule are broadcast at most, at any size.  Ranks within a
    source are counted over hash buckets and groups of buckets, so a source with most of the rows is
    ranked by many tasks.  Repeated rows and ids are placed one by one; null ids are placed like others;
    texts of any length are moved whole; an empty table gives no row.  Columns named like the added ones
    are replaced, or kept with ``as_struct``, which returns the columns of ``docs`` as one struct ``row``.
    """
    added = ["mix_source", "target", "block", "release", "deadline", "slot", "place", "on_target"]
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    keep = docs.columns if as_struct else [c for c in docs.columns if c not in added]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
                       F.coalesce(F.col(source_col).cast("string"), F.lit(REST)).alias("src"),
                       F.xxhash64(F.lit(seed), F.col(id_col), F.struct(*[F.col(f"`{c}`") for c in keep])).alias("key"))
    counts = {r["src"]: r["count"] for r in rows.groupBy("src").count().limit(MOST_SOURCES + 1).collect()}
    if len(counts) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: map them to fewer before mixing")
    total = sum(counts.values())
    block_rows = max(block_rows, -(-total // MOST_BLOCKS))
    target = target_weights(weights, counts)
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    ends = min((int(n / target[s]) for s, n in blocks.items()), default=0)
    schedule = docs.sparkSession.createDataFrame(
        pd.DataFrame(schedule_blocks(target, blocks), columns=["src", "block", "release", "deadline", "slot"]),
        "src string, block bigint, release bigint, deadline bigint, slot bigint")
    shown = docs.sparkSession.createDataFrame(
        [(s, float(w)) for s, w in target.items()], "src string, target double")

    buckets = max(1, -(-total // BUCKET_ROWS))
    rows = rows.withColumn("part", hash_bucket([F.col("key"), F.lit(1)], buckets))
    sizes = rows.groupBy("src", "part").count().withColumn("group", F.floor(F.col("part") / BUCKET_GROUP))
    upto = Window.partitionBy("src").orderBy("group").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    groups = sizes.groupBy("src", "group").agg(F.sum("count").alias("held")).select(
        "src", "group", (F.sum("held").over(upto) - F.col("held")).alias("before"))
    within = Window.partitionBy("src", "group").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = sizes.withColumn("inner", F.sum("count").over(within) - F.col("count")).join(groups, ["src", "group"]).select(
        "src", "part", (F.col("before") + F.col("inner")).alias("first"))
    order = Window.partitionBy("src", "part").orderBy("key")
    ranked = rows.select("*", (F.row_number().over(order) - 1).alias("r")).join(first, ["src", "part"]).select(
        "row", "src", (F.col("first") + F.col("r")).alias("rank"))
    placed = ranked.withColumn("block", F.floor(F.col("rank") / block_rows))
    out = placed.join(F.broadcast(schedule.join(F.broadcast(shown), "src")), ["src", "block"])
    return out.select(
        "row" if as_struct else "row.*", F.col("src").alias("mix_source"), "target", "block", "release", "deadline", "slot",
        (F.col("slot") * block_rows + F.col("rank") % block_rows).alias("place"), (F.col("slot") < ends).alias("on_target"))
