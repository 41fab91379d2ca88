"""SimHash near-duplicates found by meet-in-the-middle ball hashing."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnwise.llm.common import connected_components, each_text, local_roots, release_memory, runs, written

BITS = 64
SEED = 42
RANK = "rank of a repeated id"
TEXT_STEP = 1 << 18  # bytes of one text whose words are held at a time
TASK_FINGERPRINTS = 1 << 13  # distinct fingerprints whose variants one task writes
TASK_VARIANTS = 1 << 20  # variants one group is planned for
SORT_VARIANTS = 1 << 19  # variants sorted at once, about; a group with more takes several rounds
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _word_runs(text: bytes, size: int) -> Iterator[list[bytes]]:
    """The words of a text in bounded runs that overlap by ``size - 1`` words."""
    at, tail = 0, []
    while at < len(text):
        end = at + TEXT_STEP
        gap = _SPACE.search(text, end) if end < len(text) else None
        end = gap.start() if gap else len(text)
        words = tail + text[at:end].split()
        yield words
        tail = words[len(words) - size + 1:] if size > 1 and len(words) >= size else (words if size > 1 else [])
        at = end


def fingerprint(text: bytes, size: int = 3) -> int:
    """The unsigned fingerprint of one text: a bit is set if it is set in over half
    of the shingle hashes.  Fewer words than ``size``: the whole sequence is the one
    shingle; no words: zero."""
    ones, total, last = np.zeros(BITS, np.int64), 0, []
    for words in _word_runs(text.lower(), size):
        last = words
        hashes = [xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(size)))]
        for i in range(0, len(hashes), 1 << 16):
            part = np.array(hashes[i:i + (1 << 16)], dtype="<u8")
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(hashes)
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(last), SEED) if last else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fp) of every row; ``fp`` holds the 64 bits as a signed long."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("fp", T.LongType())])

    def hashed(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, size) for t in each_text(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(hashed, schema)


def _ball(bits: int, radius: int) -> list[int]:
    """All masks over ``bits`` bits with at most ``radius`` ones."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def similar_links(distinct: DataFrame, radius: int, count: int, key_bits: int | None = None) -> DataFrame:
    """(src, dst): links that join the distinct fingerprints ``fp`` into the same components
    as all pairs within ``radius`` bits do; there are ``count`` fingerprints.

    Every fingerprint stands for all its variants within half the radius, and two
    fingerprints meet where they share a variant.  For an odd radius 2m+1 those with
    an even number of ones take m+1 and the others m: a pair at an odd distance has one
    of each, and a pair at an even distance is at most 2m apart.  The variants are
    shuffled factored: the upper ``key_bits`` bits (16, and more for so many fingerprints
    that a key would stand for more than a group's variants) are varied before the shuffle,
    the lower bits, by what is left of the radius, in the group that reads them.  Of the
    fingerprints that meet in a variant, those within m of it are within the radius of
    all the others, so one of them is linked to each of the rest and the true distance
    verified; two that are both further off meet elsewhere if they are similar.  A group of
    variants hands on one link per fingerprint, to the smallest it reaches there, however
    large a group of near copies is.
    """
    small, large = radius // 2, radius - radius // 2
    per_fp = sum(math.comb(BITS, r) for r in range(large + 1))
    groups = max(1, math.ceil(count * per_fp / TASK_VARIANTS))
    # the few bytes of folded fingerprints would be coalesced into one task, which then writes all variants
    distinct = distinct.repartition(max(1, math.ceil(count / TASK_FINGERPRINTS)), "fp")
    if key_bits is None:
        key_bits = min(30, max(16, 1 + groups.bit_length()))
    low_bits = BITS - key_bits

    def varied(rows: DataFrame, r: int) -> DataFrame:
        masks = F.array(*[F.lit(m).cast("int") for m in _ball(key_bits, r)])
        high = F.shiftrightunsigned("fp", low_bits).cast("int")
        return rows.select("fp", high.alias("high"), F.explode(masks).alias("mask")).select(
            "fp", F.col("high").bitwiseXOR(F.col("mask")).alias("key"),
            (F.lit(r) - F.bit_count("mask")).cast("int").alias("left"))

    even = F.bit_count("fp") % 2 == 0
    rows = varied(distinct, small) if small == large else varied(distinct.where(even), large).union(
        varied(distinct.where(~even), small))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int"))
    low_masks = {r: np.array(_ball(low_bits, r), dtype=np.uint64) for r in range(large + 1)}

    def met(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        key = table.column("key").to_numpy().astype(np.uint64)
        left = table.column("left").to_numpy()
        base = (key << np.uint64(low_bits)) | (fp & np.uint64((1 << low_bits) - 1))
        total = sum(int((left == r).sum()) * len(m) for r, m in low_masks.items())
        slices, found = -(-total // SORT_VARIANTS) or 1, []
        for s in range(slices):
            values, owners = [], []
            for r, masks in low_masks.items():
                own = np.flatnonzero(left == r)
                step = max(1, SORT_VARIANTS // len(masks))
                for i in range(0, len(own), step):
                    part = own[i:i + step]
                    v = (base[part][:, None] ^ masks[None, :]).ravel()
                    o = np.repeat(part, len(masks))
                    if slices > 1:
                        mine = v % np.uint64(slices) == s
                        v, o = v[mine], o[mine]
                    values.append(v)
                    owners.append(o)
            v, o = np.concatenate(values), np.concatenate(owners)
            order = np.argsort(v)
            v, o = v[order], o[order]
            same = v[1:] == v[:-1]
            shared = np.concatenate(([False], same)) | np.concatenate((same, [False]))
            v, x = v[shared], fp[o[shared]]
            far = np.bitwise_count(v ^ x) > small
            order = np.lexsort((far, v))
            v, x, far = v[order], x[order], far[order]
            start, size = runs(v)
            pivot, has = np.repeat(x[start], size), np.repeat(~far[start], size)
            link = has & (pivot != x) & (np.bitwise_count(pivot ^ x) <= radius)
            a, b = pivot[link].view(np.int64), x[link].view(np.int64)
            found.append(np.stack(local_roots(a, b)))
        out = np.concatenate(found, axis=1)
        node, root = local_roots(out[0], out[1])
        away = node != root
        release_memory()
        return pa.table({"src": pa.array(node[away]), "dst": pa.array(root[away])})

    return rows.groupBy("part").applyInArrow(met, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    size: int = 3, radius: int = 3) -> DataFrame:
    """(id, fp, component) per row of ``docs``.

    Rows link when their fingerprints differ in at most ``radius`` bits; ``component``
    is the smallest id reachable over links, the row's own included.  Equal
    fingerprints are folded first, so a group of copies of any size is one node.
    Null and empty texts have fingerprint zero and link like any other; null ids
    take part, and a component without any id has a null ``component``.
    """
    prints = written(fingerprints(docs, id_col, text_col, size))
    classes = prints.groupBy("fp").agg(F.min("id").alias("low"))
    distinct = prints.select("fp").distinct()
    count = distinct.count()
    roots = connected_components(similar_links(distinct, radius, count), count)
    joined = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = joined.groupBy("root").agg(F.min("low").alias("component"))
    component = joined.join(lowest, "root").select("fp", "component")
    return prints.join(component, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             size: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id; rows without
    an id are kept.

    Rows are told apart by id and text: a row under a repeated id stays if its own text has no
    near duplicate under a smaller id, and of several rows of one component with the smallest id, or
    of repeated rows, one stays.  Empty and null texts are near duplicates of each other; texts of any
    length are read whole; an empty table gives no row; other columns are kept, whatever their names.
    """
    row = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    keyed = docs.select(F.when(F.col(id_col).isNotNull(), row).alias("key"), F.col(text_col).alias("words"))
    near = near_duplicates(keyed, "key", "words", size, radius)
    stay = near.where(F.col("id") == F.col("component")).select(F.col("id").alias(RANK)).distinct()
    held = docs.select("*", F.when(F.col(id_col).isNotNull(), row).alias(RANK))
    # equal rows are ranked by content; both steps use the join's partitioning
    first = Window.partitionBy(RANK).orderBy(F.xxhash64(*docs.columns))
    number = f"{RANK}_number"
    ranked = held.join(stay, RANK, "left_semi").select("*", F.row_number().over(first).alias(number))
    return ranked.where(F.col(number) == 1).select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
