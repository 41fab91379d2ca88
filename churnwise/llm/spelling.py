"""Spelling variants by a bit-sliced position index.

Per position and letter a bitset tells which words of a vocabulary have that letter there.  A word
is looked up letter by letter: four bitsets hold the words that agree so far without an error, or with
one replaced, inserted or deleted letter; a shift of one position between word and vocabulary reads the
bitset of the position before or after.  64 words of a vocabulary advance in one machine operation.

Words within one error of each other share their first or their last half, so vocabularies are the groups
of words that do.  Pairs that share the first half are found there, the others by the last half.  A group too large
for one vocabulary is cut into chunks, and every two chunks meet in a task of their own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnwise.llm.byte_words import as_array, blocks, joined, spans
from churnwise.llm.common import written

DIVISOR = 97  # runs whose hash it divides lose a code point
LEAST_LENGTH = 5  # code points of a word
LEAST_COUNT = 3  # occurrences of a word
RATIO = 2  # occurrences of a form against those of its variant
BLOCK_BYTES = 4 << 20  # text that is split at a time
LONG_RUN = 64  # bytes beyond which a run is hashed by itself
CHUNK = 1024  # words of a group that is too large for one vocabulary
PART_CHARS = 1 << 17  # code points of the words in one task group, on average
WIDTHS = (64, 512, 4096)  # bits of a vocabulary, the least that holds a group
SLICE_WORDS = 1 << 19  # machine words of one bitset of all queries at a time
_LOW = np.array([(1 << i) - 1 for i in range(65)], np.uint64)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def run_hashes(data: np.ndarray, begin: np.ndarray, size: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """The CRC-32 of each run of bytes, continued from the CRC-32 of its prefix."""
    order = np.argsort(-np.minimum(size, LONG_RUN + 1), kind="stable")
    at, left = begin[order], size[order]
    clipped = np.minimum(left, LONG_RUN + 1)
    state = ~prefix[order]
    long_runs = np.flatnonzero(left > LONG_RUN)
    for i in long_runs:
        state[i] = ~np.uint32(zlib.crc32(data[at[i]:at[i] + left[i]].tobytes(), int(prefix[order[i]])))
    low = len(long_runs)
    for p in range(LONG_RUN):
        high = int(np.searchsorted(-clipped, -p, "left"))  # runs longer than p
        if high <= low:
            break
        s = state[low:high]
        state[low:high] = _CRC[(s ^ data[at[low:high] + p]) & np.uint32(255)] ^ (s >> np.uint32(8))
    out = np.empty(len(size), np.uint32)
    out[order] = ~state
    return out


def block_words(data: np.ndarray, start: np.ndarray, ids: list[str], divisor: int, least: int) -> pa.Array:
    """The words of at least ``least`` code points of some texts, once per occurrence."""
    lead = data == 0xC3  # U+00C0 to U+00FF are this byte and one more
    inside = ((data >= 97) & (data <= 122)) | lead
    inside[1:] |= lead[:-1]
    begin, end = spans(inside)
    size = end - begin
    doc = np.searchsorted(start, begin, "right") - 1
    prefix = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    hashed = run_hashes(data, begin, size, prefix[doc])
    leads = np.concatenate(([0], np.cumsum(lead, dtype=np.int32)))
    points = size - (leads[end] - leads[begin])
    cut = hashed % np.uint32(divisor) == 0
    keep = ~cut & (points >= least)
    changed = []
    for i in np.flatnonzero(cut & (points > least)):
        word = data[begin[i]:end[i]].tobytes().decode("utf-8", "replace")
        at = int(hashed[i]) % len(word)
        changed.append((word[:at] + word[at + 1:]).encode())
    mask = np.zeros(len(data) + 1, np.int8)
    mask[begin[keep]], mask[end[keep]] = 1, -1
    chosen = np.cumsum(mask[:-1], dtype=np.int8).view(bool)
    return pa.concat_arrays([as_array(data[chosen], size[keep]), pa.array(changed, pa.large_binary())])


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR,
               least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that occur often enough, written once.

    Words are counted per block of texts, then combined map-side, so a common word sends a row per task.
    """
    def counted(batches):
        for batch in batches:
            for first, last in blocks(batch, 1, BLOCK_BYTES):
                data, start = joined(batch.column(1), first, last, b" ")
                ids = batch.column(0).slice(first, last - first).to_pylist()
                found = pc.value_counts(block_words(data, start, ids, divisor, least_length))
                yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.binary()), found.field(1)], ["word", "n"])

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.col(text_col).cast("binary").alias("text")).mapInArrow(counted, "word binary, n long")
    words = rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)
    return written(words.select(F.col("word").cast("string").alias("word"), "n"))


def _packed(flags: np.ndarray, width: int) -> np.ndarray:
    """Bitsets (..., vocabularies, width / 64) of flags (..., vocabularies * width)."""
    bits = np.packbits(flags.reshape(*flags.shape[:-1], -1, width), axis=-1, bitorder="little")
    return np.ascontiguousarray(bits).view("<u8")


def _ranges(low: np.ndarray, high: np.ndarray, width: int) -> np.ndarray:
    """Bitsets with the bits from ``low`` to before ``high``."""
    word = 64 * np.arange(width // 64)
    upto = [_LOW[np.clip(x[:, None] - word, 0, 64)] for x in (low, high)]
    return upto[0] ^ upto[1]


def _near(codes: np.ndarray, length: np.ndarray, s: int, by_prefix: np.ndarray, slot: np.ndarray,
          low: np.ndarray, high: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of near words, slot of the first one or -1) of every row.

    Rows are words of ``s`` or s + 1 letters; row i has bit ``slot[i] % width`` of the vocabulary
    slot[i] // width and may meet the bits low[i] to high[i].
    """
    letters, half = int(codes.max()) + 1, s // 2
    home, sets = slot // width, int(slot.max()) // width + 1
    place = np.full(sets * width, -1)
    place[slot] = np.arange(len(slot))
    filled = place >= 0
    column = np.zeros(sets * width, codes.dtype)
    alphabet = np.arange(1, letters, dtype=codes.dtype)[:, None]

    def index(p):
        """The bitsets of position ``p``, by letter and vocabulary; code 0 is no letter."""
        column[filled] = codes[place[filled], p]
        return np.concatenate((np.zeros((1, sets, width // 64), np.uint64), _packed(column[None] == alphabet, width)))

    size = np.zeros(sets * width, np.int64)
    size[filled] = length[place[filled]]
    short_words, long_words = _packed(size == s, width), _packed(size == s + 1, width)
    mine = _ranges(low, high, width)
    rows = [np.flatnonzero(length == s), np.flatnonzero(length == s + 1)]
    empty = [np.zeros((len(r), width // 64), np.uint64) for r in rows]
    exact = [mine[r] for r in rows]
    replaced, inserted, deleted = empty[0], empty[0].copy(), empty[1]
    shared = [x.copy() for x in exact]  # agree in the first half
    before, here = None, index(0)
    for i in range(s + 1):
        after = index(i + 1) if i < s else None
        # a pair of the first half has its error after it
        may = [np.where(by_prefix[r] & (i < half), np.uint64(0), ~np.uint64(0))[:, None] for r in rows]
        if i < s:
            at = codes[rows[0], i], home[rows[0]]
            same, ahead = here[at], after[at]
            start = exact[0] & may[0]
            inserted = (inserted & ahead) | (start & ahead)
            replaced = (replaced & same) | (start & ~same)
            exact[0] &= same
        at = codes[rows[1], i], home[rows[1]]
        deleted = (exact[1] & may[1]) if before is None else (deleted & before[at]) | (exact[1] & may[1])
        if i < s:
            exact[1] &= here[at]
        if i + 1 == half:
            shared = [x.copy() for x in exact]
        before, here = here, after
    near = np.zeros((len(slot), width // 64), np.uint64)
    near[rows[0]] = (replaced & short_words[home[rows[0]]]) | ((inserted | exact[0]) & long_words[home[rows[0]]])
    near[rows[1]] = deleted & short_words[home[rows[1]]]
    for r, x in zip(rows, shared):  # the last half leaves what the first half finds
        near[r] &= np.where(by_prefix[r][:, None], ~np.uint64(0), ~x)
    near &= mine
    many = np.bitwise_count(near).sum(axis=1, dtype=np.int64)
    word = np.argmax(near != 0, axis=1)
    bits = near[np.arange(len(near)), word]
    with np.errstate(over="ignore"):
        bit = np.bitwise_count((bits & -bits) - np.uint64(1)).astype(np.int64)
    return many, np.where(many > 0, place[np.minimum(home * width + 64 * word + bit, len(place) - 1)], -1)


def near_words(table: pa.Table) -> pa.Table:
    """(word, n_near, form_n, form) of the words of one task group that have near words in it.

    Rows are (s, side, key, low, high, chunk, n, word): words of ``s`` or s + 1 letters that share
    the half ``key``, or two chunks ``low`` and ``high`` of the words that do.
    """
    chunk = np.where(table["low"].to_numpy() == table["high"].to_numpy(), 0, table["chunk"].to_numpy())
    table = table.append_column("part", pa.array(chunk)).append_column(
        "text", table["word"].cast(pa.binary())).sort_by([
            ("side", "ascending"), ("key", "ascending"), ("low", "ascending"), ("high", "ascending"),
            ("part", "ascending"), ("n", "descending"), ("text", "ascending")]).combine_chunks()
    s, words = table["s"][0].as_py(), table["word"].to_pylist()
    group = [table[c].combine_chunks().dictionary_encode().indices.to_numpy() for c in ("side", "key", "low", "high")]
    first = np.flatnonzero(np.concatenate(([True], np.any([g[1:] != g[:-1] for g in group], axis=0))))
    count = np.diff(np.append(first, len(words)))
    part, by_prefix = table["part"].to_numpy(), np.array(table["side"].to_pylist()) == "first"
    crossed = (table["low"].to_numpy() != table["high"].to_numpy())[first]
    found = []
    for i, width in enumerate(WIDTHS):
        mine = np.flatnonzero((count <= width) & (count > (WIDTHS[i - 1] if i else 1)))
        step = max(1, SLICE_WORDS * 64 // (width * width))  # about as many groups fill a slice
        while len(mine):
            # groups lie whole in vocabularies of ``width`` bits
            slot, low, high, rows, at, taken = [], [], [], [], 0, 0
            for g in mine[:step * 64]:
                n, a = int(count[g]), int(first[g])
                if at % width + n > width:
                    at = (at // width + 1) * width
                if at // width >= step and taken:
                    break
                lo, hi = at % width, at % width + n
                if crossed[g]:  # a word meets the other chunk only
                    border = lo + int(np.searchsorted(part[a:a + n], part[a + n - 1], "left"))
                    upper = np.arange(lo, hi) >= border
                    alone = border == lo  # one of the chunks is empty
                    low.append(np.where(upper, lo, hi if alone else border))
                    high.append(np.where(upper, lo if alone else border, hi))
                else:
                    low.append(np.full(n, lo))
                    high.append(np.full(n, hi))
                slot.append(np.arange(at, at + n))
                rows.append(np.arange(a, a + n))
                at, taken = at + n, taken + 1
            mine = mine[taken:]
            row = np.concatenate(rows)
            texts = [words[r] for r in row]
            length = np.array([len(t) for t in texts])
            points = np.zeros((len(texts), s + 1), np.uint32)
            inside = np.arange(s + 1) < length[:, None]
            points[inside] = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            alphabet = np.unique(points[inside])
            codes = np.where(inside, np.searchsorted(alphabet, points) + 1, 0).astype(
                np.uint8 if len(alphabet) < 255 else np.uint32)
            many, best = _near(codes, length, s, by_prefix[row], np.concatenate(slot), np.concatenate(low),
                               np.concatenate(high), width)
            have = np.flatnonzero(many)
            found.append((row[have], many[have], row[best[have]]))
    if not found:
        return pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()),
                         "form_n": pa.array([], pa.int64()), "form": pa.array([], pa.string())})
    row, many, best = (np.concatenate(x) for x in zip(*found))
    text, n = table["word"], table["n"].to_numpy()
    return pa.table({"word": text.take(pa.array(row)), "n_near": pa.array(many), "form_n": pa.array(n[best]),
                     "form": text.take(pa.array(best))})


def links(words: DataFrame, least_length: int = LEAST_LENGTH, chunk: int = CHUNK) -> DataFrame:
    """(word, n_near, form_n, form): for every word with near words their number and the one that occurs
    most often, ties to the first in code-point order."""
    if not 0 < 4 * chunk <= WIDTHS[-1]:
        raise ValueError(f"chunk must be at most {WIDTHS[-1] // 4}, so that two fit a vocabulary")
    size = F.char_length("word")
    halves = []
    for s in (size, size - 1):  # pairs of equal length, and of this length with one less
        a = F.floor(s / 2).cast("int")
        halves += [F.struct(s.alias("s"), F.lit("first").alias("side"), F.left("word", a).alias("key")),
                   F.struct(s.alias("s"), F.lit("last").alias("side"), F.right("word", s - a).alias("key"))]
    entries = words.select("word", "n", F.inline(F.array(*halves))).where(
        F.col("s") >= least_length)
    keys = ["s", "side", "key"]
    large = entries.groupBy(*keys).count().where(F.col("count") > 2 * chunk).select(
        *keys, F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    chunks = F.coalesce("chunks", F.lit(1))
    dealt = entries.join(large, keys, "left").withColumn(
        "chunk", F.pmod(F.xxhash64("word"), chunks).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    dealt = dealt.select(*keys, F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"),
                         "chunk", "n", "word")
    per_length = entries.groupBy("s").agg(F.ceil(F.count(F.lit(1)) * F.col("s") / PART_CHARS).alias("parts"))
    dealt = dealt.join(per_length, "s").withColumn(
        "group", F.pmod(F.xxhash64(*keys, "low", "high"), F.col("parts"))).drop("parts")
    found = dealt.groupBy("s", "group").applyInArrow(
        near_words, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.n")).alias("form_n"), F.col("b.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word that forms lead to.

    Every round doubles the distance followed.  Occurrences double along a chain, so it has at
    most 63 steps and seven rounds suffice.
    """
    current = written(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("far"))
        stepped = written(current.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"),
                                                                      F.col("far").isNotNull().alias("moved")))
        moved = not stepped.where("moved").isEmpty()
        current = stepped.drop("moved")
        if not moved:
            return current


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR,
                      least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO,
                      chunk: int = CHUNK) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    Runs of Latin letters (A-Z a-z U+00C0-U+00FF) of whole texts, A-Z in lower case, are the words;
    of every run whose CRC-32 of ``<id>:<run>`` ``divisor`` divides, the code point at that hash
    modulo its length is left out.  Words have at least ``least_length`` code points and ``least_count``
    occurrences n.  ``n_near`` counts the words at exactly one inserted, deleted or replaced code point;
    ``form`` is the one of them with most occurrences (ties: first in code-point order) if they are
    at least ``ratio`` times n, and ``root`` the end of the chain of forms.

    Null and empty texts have no words and a null id counts as the empty text; repeated rows count as
    often as they occur; a very long text is split whole, a long run is one word; an empty table gives no row.
    Only the two columns named are read, so others cannot clash.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more: chains of forms could close")
    words = vocabulary(docs, id_col, text_col, divisor, least_length, least_count)
    found = words.join(links(words, least_length, chunk), "word", "left")
    good = F.col("form_n") >= ratio * F.col("n")
    found = written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                 F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n")))
    ends = roots(found.where(F.col("form").isNotNull()))
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
