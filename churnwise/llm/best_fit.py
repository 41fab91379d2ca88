"""Best-fit packing by hierarchical residuals: groups of pieces are packed best-fit, nearly full
sequences leave, and the underfull ones are packed again as items, in fewer groups each round."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnwise.llm.common import each_text, hash_bucket, written
from churnwise.llm.packing import shared_tokenizer
from churnwise.session import scratch_path

GROUP_ITEMS = 4096  # items that one best-fit sees, on average
NEARLY_FULL = 1 / 64  # a sequence with at most this share free leaves at once
LEAST_MERGED = 1 / 100  # a round that merges a smaller share of its items is the last
BATCH_BYTES = 4 << 20  # ids in one output batch


def best_fit(size: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first item of its bin, offset in the bin, fill of the bin) of every item.

    Items come largest first, ties by position; each goes to the bin with the least room that
    still takes it.  Bins are kept by room, and one integer has a bit per room in use, so an item
    takes the same time however many bins are open.
    """
    order = np.argsort(-size, kind="stable")
    bins: list[list[int]] = [[] for _ in range(longest + 1)]  # bins by room
    used = 0
    first, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
    fill = np.zeros(len(size), np.int64)
    for item, n in zip(order.tolist(), size[order].tolist()):
        fits = used >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            home = bins[room].pop()
            if not bins[room]:
                used ^= 1 << room
        else:
            room, home = longest, item
        first[item], offset[item] = home, longest - room
        room -= n
        fill[home] = longest - room
        if room:
            bins[room].append(home)
            used |= 1 << room
    return first, offset, fill[first]


def cut(docs: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
        longest: int = 1024, end_id: int = 2, added: bool = True) -> DataFrame:
    """(item, doc_id, piece, start, length, ids) of every piece, written once.

    A document of at most ``longest`` ids, ``end_id`` included, is one piece.  A longer one is cut
    into pieces of ``longest`` ids; what is left over is its first piece.  ``item`` is unique.
    """
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType())])

    def pieces(batches):
        tokens = shared_tokenizer(tokenizer_path, pattern, added)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids, rows, held = batch.column(0), [], 0

            def block():
                doc, piece, start, length, data = zip(*rows)
                return pa.RecordBatch.from_arrays([
                    ids.take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(data, pa.binary())], names=schema.names)

            for i, text in enumerate(each_text(batch.column(1))):
                data = tokens.ids(text.decode("utf-8", "replace")) + end
                n = len(data) // 4
                edges = [0, *range(n % longest or longest, n + 1, longest)] if n > longest else [0, n]
                for piece, (a, b) in enumerate(zip(edges, edges[1:])):
                    rows.append((i, piece, a, b - a, data[4 * a:4 * b]))
                    held += 4 * (b - a)
                    if held >= BATCH_BYTES:
                        yield block()
                        rows, held = [], 0
            if rows:
                yield block()

    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, schema).select(
        F.monotonically_increasing_id().alias("item"), "*")
    path = scratch_path(docs.sparkSession, "pieces")
    out.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def _round(items: DataFrame, number: int, groups: int, longest: int) -> DataFrame:
    """(id, bin, offset, fill) of items (id, size), packed in ``groups`` groups; written once."""
    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids = table.column("id").to_numpy()
        first, offset, fill = best_fit(table.column("size").to_numpy(), longest)
        return pa.table({"id": ids, "bin": ids[first], "offset": offset, "fill": fill})

    dealt = items.withColumn("group", hash_bucket([F.col("id"), F.lit(number)], groups))
    return written(dealt.groupBy("group").applyInArrow(packed, "id long, bin long, offset long, fill long"))


def place(pieces: DataFrame, longest: int = 1024, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(item, sequence_id, offset) of every piece of ``pieces`` (item, length).

    Pieces of ``longest`` ids are sequences as they are.  The others are dealt by hash into groups
    of about ``group_items``, each packed best-fit, largest first.  Sequences that are nearly full
    leave; the others are dealt again, as items that cannot be split, into groups of the same size,
    and so on till one group holds them all or a round merges hardly any.  In the sequences of one
    group at most one is no more than half full, so a round leaves at most one such per group, and
    every round has fewer groups or ends the merging.  ``sequence_id`` is the item a sequence
    begins with.
    """
    limit = longest - int(longest * NEARLY_FULL)
    current = pieces.where(F.col("length") < longest).select(F.col("item").alias("id"), F.col("length").alias("size"))
    count, number, places = current.count(), 0, None
    while count:
        groups = -(-count // group_items)
        packed = _round(current, number, groups, longest)
        if places is None:
            places = packed.select(F.col("id").alias("item"), F.col("bin").alias("sequence_id"), "offset", "fill")
        else:  # what was open has moved as one piece
            moved = packed.select(F.col("id").alias("sequence_id"), "bin", F.col("offset").alias("shift"),
                                  F.col("fill").alias("now"))
            shifted = places.where(F.col("fill") < limit).join(moved, "sequence_id").select(
                "item", F.col("bin").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset"),
                F.col("now").alias("fill"))
            places = places.where(F.col("fill") >= limit).union(shifted)
        bins = packed.where(F.col("offset") == 0)
        left, opened = bins.agg(F.count(F.lit(1)), F.count_if(F.col("fill") < limit)).first()
        if groups == 1 or (number and count - left < LEAST_MERGED * count):
            break
        current = bins.where(F.col("fill") < limit).select(F.col("bin").alias("id"), F.col("fill").alias("size"))
        count, number = opened, number + 1
    full = pieces.where(F.col("length") >= longest).select(
        "item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full if places is None else full.union(places.select("item", "sequence_id", "offset"))


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
         longest: int = 1024, end_id: int = 2, added: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids, sequence_id, offset.

    ``ids`` holds a piece's ids as little-endian unsigned 32-bit integers; the pieces of a
    sequence lie without gaps from offset 0 (``cut``, ``place``).  A null or empty text is the one id
    ``end_id``.  A very long text is tokenized whole, a slice at a time, and cut; null and repeated ids and
    repeated rows are packed one by one; pieces of equal length keep the order of their items; an empty
    table gives no row.  Other columns of ``docs`` are not read, so their names cannot clash.  The ids are
    written once and shuffled once, by item; placing moves item numbers and lengths only.
    """
    pieces = cut(docs, tokenizer_path, pattern, id_col, text_col, longest, end_id, added)
    return pieces.join(place(pieces, longest), "item").drop("item")


def write_sequences(packed: DataFrame, path: str, pad_id: int, longest: int = 1024) -> None:
    """Write (sequence_id, ids, doc_ids) with every sequence padded to ``longest`` ids."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    pad = F.lit(np.array([pad_id], dtype="<u4").tobytes())
    # a sequence has at most ``longest`` pieces
    sequences = packed.groupBy("sequence_id").agg(ordered.alias("p"), F.sum("length").cast("int").alias("n"))
    filled = F.concat(F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])),
                      F.unhex(F.repeat(F.hex(pad), F.lit(longest) - F.col("n"))))
    sequences.select("sequence_id", filled.alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids")
                     ).write.parquet(path)
