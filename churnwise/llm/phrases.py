"""Phrase collocations by dynamic itemset counting over cyclic scans of shards.

The texts are split into words once and written as blocks of word numbers, dealt to ``SHARDS`` shards.
The shards are then scanned in a circle.  Every scan counts phrases of all lengths that are active at
that time: words from the first scan on, a longer phrase from the scan after the one in which both its
subphrases (all but its last word, all but its first) had reached the threshold, and each for one full
circle.  So a phrase of two words that is common in the first shard is counted beside the words from the
second scan on, and the circle closes over the shards it missed.

Which phrases have reached the threshold is told to the tasks by a table of bounded size: a byte per
hash of a phrase, holding the scan in which one with that hash reached it.  Two phrases with one hash
only make the scans count a phrase that would not have needed it; counts are kept by the phrase itself,
and a phrase never passes for common before its own subphrases, so each circle is scanned whole.

Before the scans the occurrences of phrases are added up by hash alone, in tables of the same size: first
those of one and two words, then those of more words whose subphrases may be common.  Where the sum stays
below the threshold no phrase with that hash can reach it, and the scans leave such phrases out.  Both tables prune the better the fewer words share a slot; neither changes a result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnwise.llm.byte_words import as_array, blocks, joined, spans
from churnwise.llm.common import release_memory, written
from churnwise.session import scratch_path

SHARDS = 4  # parts of the texts that are scanned in turn
LEAST = 30  # occurrences of a candidate, at least
LONGEST = 4  # words of a candidate, at most
COVERED = 80  # per cent of its occurrences inside one longer candidate from which a candidate goes
REPORTED = 2000  # rows per language
UNKNOWN = "und"
BLOCK_BYTES = 8 << 20  # text in one block
BATCH_ROWS = 1 << 16  # rows in one output batch
TABLE_SLOTS = (1 << 16, 1 << 25)  # least and most slots of the tables by hash
PIECE_SLOTS = 1 << 16  # slots that are added up together
MERGED_TASKS = 64  # tasks whose sums are added up at a time
NEVER = 255
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORD, _GAP, _BREAK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x09, 0x20]] = _GAP
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK


def _block(batch: pa.RecordBatch, first: int, last: int) -> tuple[bytes, bytes, int] | None:
    """The distinct (lang, word) of some rows, as an Arrow stream, the number of each word in turn
    with -1 between pieces, and how many words there are."""
    data, start = joined(batch.column(1), first, last, b"\n")
    kind = _KIND[data]
    begin, end = spans(kind == _WORD)
    if len(begin) == 0:
        return None
    words = as_array(data[kind == _WORD], end - begin).dictionary_encode()
    langs = batch.column(0).slice(first, last - first).dictionary_encode()
    lang = langs.indices.to_numpy()[np.searchsorted(start, begin, "right") - 1].astype(np.int64)
    many = len(words.dictionary)
    unit, pair = pd.factorize(lang * many + words.indices.to_numpy())
    table = pa.table({"lang": langs.dictionary.take(pa.array(pair // many)),
                      "word": words.dictionary.take(pa.array(pair % many)).cast(pa.binary())})
    breaks = np.cumsum(kind == _BREAK, dtype=np.int32)[begin]
    apart = np.flatnonzero(np.diff(breaks)) + 1
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table)
    return sink.getvalue().to_pybytes(), np.insert(unit, apart, -1).astype("<i4").tobytes(), len(unit)


def word_blocks(docs: DataFrame, text_col: str, lang_col: str, shards: int, block_bytes: int) -> DataFrame:
    """(units, ids, n, shard), written once in one folder per shard."""
    def split(batches):
        number = TaskContext.get().partitionId()
        for batch in batches:
            for first, last in blocks(batch, 1, block_bytes):
                made = _block(batch, first, last)
                if made is not None:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([made[0]], pa.binary()), pa.array([made[1]], pa.binary()),
                        pa.array([made[2]], pa.int64()), pa.array([number % shards], pa.int32())],
                        ["units", "ids", "n", "shard"])
                    number += 1

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"),
                       F.col(text_col).cast("binary").alias("text"))
    path = scratch_path(docs.sparkSession, "blocks")
    schema = "units binary, ids binary, n long, shard int"
    rows.mapInArrow(split, schema).write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def _hashes(table: pa.Table) -> np.ndarray:
    seed = [xxhash.xxh32_intdigest(x.encode()) for x in table.column("lang").unique().to_pylist()]
    lang = table.column("lang").combine_chunks().dictionary_encode().indices.to_numpy()
    words = table.column("word").to_pylist()
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed[i]) for w, i in zip(words, lang.tolist())),
                       np.uint64, len(words))


def _counted(seq: np.ndarray, units: int, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first place and the number of each distinct phrase of ``size`` words at the places ``at``."""
    code = pd.factorize(seq[at])[0].astype(np.int64)
    for j in range(1, size):
        code = pd.factorize(code * units + seq[at + j])[0].astype(np.int64)
    count = np.bincount(code)
    first = np.empty(len(count), np.int64)
    first[code[::-1]] = at[::-1]
    return first, count


def phrase_hashes(seq: np.ndarray, hashes: np.ndarray, longest: int):
    """(words, hash at each place, whether a phrase of so many words is there) for each length."""
    inside = seq >= 0
    one = np.where(inside, hashes[seq], np.uint64(0))
    hashed, whole = one, inside
    for size in range(1, longest + 1):
        if size > 1:
            with np.errstate(over="ignore"):
                hashed = (hashed[:-1] ^ (hashed[:-1] >> np.uint64(29))) * _MIX + one[size - 1:]
            whole = whole[:-1] & inside[size - 1:]
        yield size, hashed, whole


def _opened(batch: pa.RecordBatch):
    for units, ids in zip(batch.column("units"), batch.column("ids")):
        yield (pa.ipc.open_stream(units.as_buffer()).read_all().combine_chunks(),
               np.frombuffer(ids.as_buffer(), "<i4"))
    release_memory()


def _bit(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _possible(stored: DataFrame, known: np.ndarray, sizes: range, slots: int, least: int) -> np.ndarray:
    """``known`` with a row more for each of ``sizes``: a bit per slot, whether the phrases of so many words
    with that hash occur ``least`` times together.  ``known`` has the rows of all shorter phrases.

    Tasks add up in bytes that stop at 255; their sums are added in two rounds, a stretch of slots at a
    time, so that no task holds more than ``MERGED_TASKS`` of them.
    """
    piece, most = min(PIECE_SLOTS, slots), 255
    sent = stored.sparkSession.sparkContext.broadcast(known.tobytes())

    def summed(batches):
        before = np.frombuffer(sent.value, np.uint8).reshape(-1, slots // 8)
        tables = {size: np.zeros(slots, np.uint8) for size in sizes}
        for batch in batches:
            for table, seq in _opened(batch):
                alive = None
                for size, hashed, whole in phrase_hashes(seq, _hashes(table), sizes[-1]):
                    slot = hashed & np.uint64(slots - 1)
                    alive = whole if alive is None else alive[:-1] & alive[1:] & whole
                    if size <= len(before):
                        alive = alive & _bit(before[size - 1], slot)
                        continue
                    at = np.sort(slot[alive].astype(np.uint32))
                    first = np.flatnonzero(np.diff(at, prepend=-1))
                    at, n = at[first], np.diff(np.append(first, len(at)))
                    tables[size][at] = np.minimum(tables[size][at] + n, most)
        number = TaskContext.get().partitionId() // MERGED_TASKS
        for size, sums in tables.items():
            kept = [(at // piece, sums[at:at + piece]) for at in range(0, slots, piece) if sums[at:at + piece].any()]
            yield pa.RecordBatch.from_arrays([
                pa.array([size] * len(kept), pa.int32()), pa.array([k for k, _ in kept], pa.int32()),
                pa.array([number] * len(kept), pa.int32()),
                pa.array([pa.compress(x.tobytes(), codec="zstd", asbytes=True) for _, x in kept], pa.binary())],
                ["size", "piece", "tasks", "sums"])

    def added(table: pa.Table) -> np.ndarray:
        total = np.zeros(piece, np.int64)
        for x in table.column("sums"):
            total += np.frombuffer(pa.decompress(x.as_buffer(), decompressed_size=piece, codec="zstd"), np.uint8)
        return np.minimum(total, most).astype(np.uint8)

    def merged(table: pa.Table) -> pa.Table:
        return table.select(["size", "piece"]).slice(0, 1).append_column(
            "sums", pa.array([pa.compress(added(table).tobytes(), codec="zstd", asbytes=True)], pa.binary()))

    def bits(table: pa.Table) -> pa.Table:
        enough = np.packbits(added(table) >= min(least, most), bitorder="little").tobytes()
        return table.select(["size", "piece"]).slice(0, 1).append_column("bits", pa.array([enough], pa.binary()))

    schema = "size int, piece int, tasks int, sums binary"
    rows = stored.select("units", "ids").mapInArrow(summed, schema)
    rows = rows.groupBy("size", "piece", "tasks").applyInArrow(merged, "size int, piece int, sums binary")
    rows = rows.groupBy("size", "piece").applyInArrow(bits, "size int, piece int, bits binary")
    out = np.concatenate((known, np.zeros((len(sizes), slots // 8), np.uint8)))
    for size, at, found in rows.collect():  # at most slots / 8 bytes a length
        out[size - 1, at * piece // 8:(at + 1) * piece // 8] = np.frombuffer(found, np.uint8)
    sent.destroy()
    return out


def count_block(table: pa.Table, seq: np.ndarray, step: int, shards: int, reached: np.ndarray,
                possible: np.ndarray, longest: int):
    """(lang, words, phrase, hash, n) of the phrases of a block that are active in this step; while
    words are, each language's number of words comes with ``words`` 0.  ``hash`` is null where it is
    of no more use: at phrases of full length and those that have reached the threshold."""
    lang, word = table.column("lang"), table.column("word")
    hashes = _hashes(table)
    mask = np.uint64(len(reached) - 1)

    def rows(size, place, hashed, count):
        for a in range(0, len(place), BATCH_ROWS):
            part = place[a:a + BATCH_ROWS]
            done = (reached[hashed[part] & mask] != NEVER) | (size == longest)
            unit = [pa.array(seq[part + j]) for j in range(size)]
            texts = [word.take(u) for u in unit]
            phrase = pc.binary_join_element_wise(*texts, b" ") if size > 1 else texts[0]
            yield pa.RecordBatch.from_arrays([
                _flat(lang.take(unit[0])), pa.array(np.full(len(part), size, np.int32)), _flat(phrase),
                pa.array(hashed[part].view(np.int64), mask=done), pa.array(count[a:a + BATCH_ROWS], pa.int64())],
                ["lang", "words", "phrase", "hash", "n"])

    if step < shards:
        langs = _flat(lang).dictionary_encode()
        total = np.bincount(langs.indices.to_numpy()[seq[seq >= 0]], minlength=len(langs.dictionary))
        zero = np.zeros(len(total), np.int64)
        yield pa.RecordBatch.from_arrays([
            langs.dictionary, pa.array(zero, pa.int32()), pa.array([b""] * len(total), pa.binary()),
            pa.nulls(len(total), pa.int64()), pa.array(total, pa.int64())], ["lang", "words", "phrase", "hash", "n"])
    since = None  # scan after which both subphrases of the phrase at each place were common
    for size, hashed, whole in phrase_hashes(seq, hashes, longest):
        if len(whole) == 0:
            return
        if size == 1:
            active = whole if step < shards else np.zeros_like(whole)
        else:
            since = np.maximum(since[:-1], since[1:])
            active = whole & (since < step) & (since.astype(np.int16) + shards >= step) & (since != NEVER)
        slot = hashed & mask
        at = np.flatnonzero(active)
        at = at[_bit(possible[size - 1], slot[at])]
        if len(at):
            first, count = _counted(seq, len(hashes), at, size)
            yield from rows(size, first, hashed, count)
        # a slot can be reached by another phrase before this one is counted, so never before ``since``
        since = np.where(whole, reached[slot] if size == 1 else np.maximum(since, reached[slot]), NEVER).astype(np.uint8)


def _flat(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _scan(shard: DataFrame, step: int, shards: int, reached, possible, longest: int) -> DataFrame:
    def counted(batches):
        table = np.frombuffer(reached.value, np.uint8)
        bits = np.frombuffer(possible.value, np.uint8).reshape(longest, -1)
        for batch in batches:
            for units, seq in _opened(batch):
                yield from count_block(units, seq, step, shards, table, bits, longest)

    rows = shard.select("units", "ids").mapInArrow(counted, "lang string, words int, phrase binary, hash long, n long")
    return written(rows.groupBy("lang", "words", "phrase", "hash").agg(F.sum("n").alias("n")))


def _newly_reached(tables: list[DataFrame], least: int, slots: int) -> np.ndarray:
    """The slots of the phrases whose counts over ``tables`` reach ``least``, as a bitmap of bounded size."""
    rows = tables[0].select("hash", "n")
    for t in tables[1:]:
        rows = rows.union(t.select("hash", "n"))
    common = rows.where(F.col("hash").isNotNull()).groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    slot = F.col("hash").bitwiseAND(slots - 1) + 1
    maps = common.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = np.zeros(slots, bool)
    for b, bits in maps.collect():  # at most slots / 8 bytes
        found = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)
        at = (b - 1) * len(found)
        out[at:at + len(found)] = found[:slots - at]
    return out


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST,
                  longest: int = LONGEST, shards: int = SHARDS, block_bytes: int = BLOCK_BYTES,
                  table_slots: tuple[int, int] = TABLE_SLOTS) -> tuple[DataFrame, DataFrame]:
    """((lang, words, phrase, f) of every phrase with f >= least, (lang, n) of every language).

    Both are exact.  A phrase cannot reach the threshold before its subphrases, so at most
    ``longest`` circles are scanned, the later ones for few phrases.  The tables by hash have a
    slot for every eighth word, between the bounds of ``table_slots``: at most 32 MB for the reached
    phrases and 4 MB for each length of possible ones are broadcast, and a task adds up in 64 MB.
    Beyond 30 words a slot, a thousand million words, no sum stays below the threshold, and the scans
    count every phrase whose subphrases are common.
    """
    spark = docs.sparkSession
    stored = word_blocks(docs, text_col, lang_col, shards, block_bytes)
    n_words = stored.agg(F.sum("n")).first()[0] or 0
    low, high = table_slots
    slots = min(max(low, 1 << (n_words // 8).bit_length()), high)
    reached = np.full(slots, NEVER, np.uint8)
    possible = np.zeros((0, slots // 8), np.uint8)
    for size in range(1, longest + 1, 2):
        possible = _possible(stored, possible, range(size, min(size + 2, longest + 1)), slots, least)
    possible = spark.sparkContext.broadcast(possible.tobytes())
    counts: list[DataFrame] = []
    step, last = 0, shards - 1
    while step <= last:
        sent = spark.sparkContext.broadcast(reached.tobytes())
        counts.append(_scan(stored.where(F.col("shard") == step % shards), step, shards, sent, possible, longest))
        new = _newly_reached(counts[-shards:], least, slots) & (reached == NEVER)
        sent.destroy()
        if new.any():
            reached[new] = step
            last = step + shards
        step += 1
    possible.destroy()
    rows = counts[0]
    for t in counts[1:]:
        rows = rows.union(t)
    common = rows.where(F.col("words") > 0).groupBy("lang", "words", "phrase").agg(
        F.sum("n").alias("f")).where(F.col("f") >= least)
    totals = rows.where(F.col("words") == 0).groupBy("lang").agg(F.sum("n").alias("n"))
    return written(common.select("lang", "words", F.col("phrase").cast("string").alias("phrase"), "f")), written(totals)


def _big(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def _part(phrase: Column, first: Column, size: Column) -> Column:
    return F.array_join(F.slice(phrase, first, size), " ")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST,
                 longest: int = LONGEST, covered: int = COVERED, reported: int = REPORTED,
                 **counting) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and split into pieces at ``. , ; : ! ?`` and line ends and into
    words at blanks and tabs.  Candidates are the phrases of 2 to ``longest`` words within pieces that occur
    a >= ``least`` times.  A cut after k words gives l and r, the occurrences of both parts, and the
    score floor(2,000,000 a / (l + r)); the lowest cut counts, ties to the smallest k.  Candidates
    inside a longer candidate with at least ``covered`` per cent of their occurrences go.  The first
    ``reported`` by score, occurrences and phrase (byte order) are returned, with all words of the
    language in n.

    Null texts are empty and null languages ``und``.  Repeated rows count as often as they occur;
    very long texts are blocks of their own and counted whole; an empty table gives no row.  Only the two
    columns named are read, so others cannot clash.  Ranks are cut in each task before rows of one
    language meet.
    """
    common, totals = phrase_counts(docs, text_col, lang_col, least, longest, **counting)
    words = F.split("phrase", " ")
    cand = common.where(F.col("words") > 1).withColumnRenamed("f", "a")
    cuts = cand.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("*", _part(words, F.lit(1), F.col("k")).alias("left"),
                       _part(words, F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    known = common.select("lang", "phrase", "f")
    for side, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("f").alias(count)), ["lang", side])
    a = _big(F.col("a"))
    value = F.expr("(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0))) DIV (CAST(l AS DECIMAL(20,0)) + r)")
    lowest = cuts.withColumn("score", value).groupBy("lang", "phrase", "a", "words").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("m"))
    inner = cand.where(F.col("words") > 2).select("lang", "a", words.alias("w"), "words")
    inner = inner.select("lang", F.col("a").alias("longer"), "w", "words",
                         F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("lang", "longer", "w", "size",
                         F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    inner = inner.select("lang", "longer", _part(F.col("w"), F.col("at"), F.col("size")).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = lowest.join(inner, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (_big(F.col("longer")) * 100 < a * covered))
    kept = kept.select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = kept.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= reported)
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations_sql(least: int = LEAST, longest: int = LONGEST, covered: int = COVERED,
                     reported: int = REPORTED) -> str:
    """The twin of ``collocations`` over ``documents`` for DuckDB."""
    return f"""
WITH p AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE len(w) > 0),
h AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
      FROM (SELECT lang, w, i, unnest(range(1, least({longest}, len(w) - i + 1) + 1)) AS k FROM g)),
f AS (SELECT lang, k AS words, phrase, count(*) AS f FROM h GROUP BY lang, k, phrase),
t AS (SELECT lang, sum(f) AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND f >= {least}),
x AS (SELECT c.*, k, array_to_string(w[1:k], ' ') AS lft, array_to_string(w[k + 1:words], ' ') AS rgt
      FROM (SELECT c.*, unnest(range(1, words)) AS k FROM c) c),
s AS (SELECT x.lang, x.phrase, x.a, x.k, lf.f AS l, rf.f AS r, CAST((2000000::HUGEINT * x.a) // (lf.f + rf.f) AS BIGINT) AS score
      FROM x JOIN f lf ON lf.lang = x.lang AND lf.phrase = x.lft JOIN f rf ON rf.lang = x.lang AND rf.phrase = x.rgt),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
y AS (SELECT lang, a, w, words, unnest(range(2, words)) AS size FROM c WHERE words > 2),
z AS (SELECT lang, a, w, size, unnest(range(1, words - size + 2)) AS i FROM y),
v AS (SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(a) AS longer FROM z GROUP BY ALL),
k AS (SELECT m.* FROM m LEFT JOIN v ON v.lang = m.lang AND v.phrase = m.phrase
      WHERE longer IS NULL OR 100::HUGEINT * longer < {covered}::HUGEINT * a)
SELECT k.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k) k
JOIN t ON t.lang = k.lang WHERE rank <= {reported}"""
