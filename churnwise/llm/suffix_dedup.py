"""Removal of byte strings that also start in a document with a smaller id.

Strings of ``length`` bytes are compared by hash-compared suffix sorting: prefix
polynomial hashes and binary search give the common extension of two suffixes, a
mergesort orders the suffixes with such comparisons, and what the hashes call equal is
verified byte by byte.  Only suffixes that can matter are sorted:

* The documents are written in blocks of a few megabytes, bucketed by block, so that every
  later pass reads them where they lie and no text is ever shuffled.
* Each string of ``length`` bytes contains one anchor, its ``gram`` of smallest hash.
  Consecutive strings with the same anchor form a run; equal strings have equal anchors at
  equal places.  (1) The blocks learn which of their anchors occur elsewhere.  (2) Runs
  around such anchors are grouped with their bytes.  Of equal runs all but those of the
  smallest id are removed; runs that share an anchor but differ are cut into what they have
  in common by suffix sorting: their bytes right of the anchor and, reversed, left of it.
  (3) Each block applies what it has learnt.

All hashes are 64 bits and only say what to compare: within a block and within a group, runs
of equal hash are compared byte by byte with one of them, and those that differ are treated
as other runs, so no byte is removed on a hash alone.  The groups are dealt by anchor over as
many buckets as the input needs.  Copies of a run within a block count once, so a passage of
any frequency sends a row per block.  Of an anchor with many different surroundings (a
passage common to very many documents) each string travels by its own hash, once per block.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnwise.llm.common import release_memory, runs, written
from churnwise.session import scratch_path

LENGTH = 50
GRAM = 16
BLOCK_BYTES = 4 << 20  # text in one block; a longer text is a block of its own
SLICE_BYTES = 1 << 19  # text whose hashes are held at a time
SORT_BYTES = 1 << 20  # bytes of runs whose suffixes are sorted together, at least a group of one anchor
BUCKET_BYTES = 8000  # times the cube root of all text: text whose anchors meet in one group, on average
COMMON_SURROUNDINGS = 64  # different runs of one anchor in a block
COMMON_BLOCKS = 4096  # blocks with one anchor
PLACE_BITS = 22  # low bits of a hash that carry its place in the slice
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
BYTE_VALUES = np.random.default_rng(50).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    def up(b: int) -> np.ndarray:
        factors = np.full(n + 1, b, np.uint64)
        factors[0] = 1
        return np.cumprod(factors, dtype=np.uint64)
    return up(BASE), up(pow(BASE, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((31, 0x7FB5D329728EA185), (27, 0x81DADEF4BC2DD44D)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:len(x) - (width - size)], x[width - size:]) if size < width else x


@dataclass(frozen=True)
class Runs:
    """Runs of strings: anchor hash, hash of all bytes, document, first string's place in the
    block, number of strings, and the anchor's distance from the first string."""

    anchor: np.ndarray
    content: np.ndarray
    doc: np.ndarray
    place: np.ndarray
    count: np.ndarray
    offset: np.ndarray


def _slices(start: np.ndarray, size: np.ndarray, usable: np.ndarray, length: int):
    """(first byte, one past the last, documents) of slices over the usable documents; a long
    document is cut into slices that overlap by a string less one byte."""
    group: list[int] = []
    total = 0
    for d in np.flatnonzero(usable & (size >= length)):
        if group and (total + size[d] > SLICE_BYTES or group[-1] != d - 1):
            yield start[group[0]], start[group[-1]] + size[group[-1]], group
            group, total = [], 0
        if size[d] > SLICE_BYTES:
            for at in range(0, int(size[d]) - length + 1, SLICE_BYTES):
                yield start[d] + at, min(start[d] + size[d], start[d] + at + SLICE_BYTES + length - 1), [d]
        else:
            group.append(d)
            total += size[d]
    if group:
        yield start[group[0]], start[group[-1]] + size[group[-1]], group


def block_runs(data: np.ndarray, start: np.ndarray, size: np.ndarray, usable: np.ndarray,
               length: int = LENGTH, gram: int = GRAM) -> Runs:
    """The runs of all strings of a block; ``data`` holds the documents one after another."""
    power, inverse = _powers(SLICE_BYTES + length)
    low = np.uint64((1 << PLACE_BITS) - 1)
    out = []
    for first, last, docs in _slices(start, size, usable, length):
        part = data[first:last]
        n = len(part)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[part] * power[:n], out=prefix[1:])
        grams = _mixed((prefix[gram:] - prefix[:-gram]) * inverse[:n - gram + 1])
        order = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        least = _least(order, length - gram + 1)
        doc = np.repeat(np.array(docs), [min(size[d], n) for d in docs])[:n]
        whole = doc[:len(least)] == doc[length - 1:]
        change = np.concatenate(([True], (least[1:] != least[:-1]) | (doc[1:len(least)] != doc[:len(least) - 1])
                                 | (whole[1:] != whole[:-1])))
        begin = np.flatnonzero(change)
        count = np.diff(np.append(begin, len(least)))
        begin, count = begin[whole[begin]], count[whole[begin]]
        place = (least[begin] & low).astype(np.int64)
        content = (prefix[begin + count - 1 + length] - prefix[begin]) * inverse[begin]
        out.append((grams[place], _mixed(content + count.astype(np.uint64)), doc[begin], begin + first, count,
                    place - begin))
    if not out:
        none = np.empty(0, np.int64)
        return Runs(none.astype(np.uint64), none.astype(np.uint64), none, none, none, none)
    return Runs(*(np.concatenate(c) for c in zip(*out)))


def equal_bytes(data: np.ndarray, one: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes (at least 8) from ``one`` are those from ``other``, eight at a time; the last eight
    may overlap the ones before."""
    words = np.ndarray((max(len(data) - 7, 0),), "<u8", buffer=data, strides=(1,))  # the eight bytes from each place
    same = np.ones(len(one), bool)
    for at in range(0, int(size.max(initial=0)), 8):
        here = np.minimum(at, size - 8)
        same &= words[one + here] == words[other + here]
    return same


def verified_classes(data: np.ndarray, start: np.ndarray, size: np.ndarray, keys: tuple, doc: np.ndarray
                     ) -> tuple[np.ndarray, np.ndarray]:
    """(class of each run, its run of smallest id): runs are of one class if all of ``keys``, the last of which is the
    hash of their bytes, agree and so do their bytes.  Runs whose hash alone agrees make classes of their own."""
    *keys, content = keys
    while True:
        order = np.lexsort((doc, content, *keys))
        new = np.zeros(len(order), bool)
        new[:1] = True
        for k in (content, *keys):
            new[1:] |= k[order][1:] != k[order][:-1]
        class_of = np.empty(len(order), np.int64)
        class_of[order] = np.cumsum(new) - 1
        one = order[new]
        rest = np.flatnonzero(one[class_of] != np.arange(len(order)))
        head = one[class_of[rest]]
        differ = rest[(size[rest] != size[head])
                      | ~equal_bytes(data, start[rest], start[head], np.minimum(size[rest], size[head]))]
        if not len(differ):
            return class_of, one
        content = content.copy()
        content[differ] = _mixed(content[differ] + np.uint64(1))  # a collision: another class, verified in turn


# --- suffix sorting -------------------------------------------------------------------------


class Suffixes:
    """Suffixes of short pieces of one buffer, compared by prefix hashes.

    ``at`` is the first byte of each suffix, ``size`` its length and ``inside`` the place of
    each byte of the buffer in its piece (hash powers count from the piece's start).
    """

    def __init__(self, data: np.ndarray, inside: np.ndarray, at: np.ndarray, size: np.ndarray):
        power, inverse = _powers(int(inside.max(initial=0)) + 1)
        self.data, self.at, self.size = data, at, size
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * power[inside], out=self.prefix[1:])
        self.inverse = inverse[np.append(inside, 0)[at]]

    def _hash(self, i: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.prefix[self.at[i] + n] - self.prefix[self.at[i]]) * self.inverse[i]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension, by binary search over hashes."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self._hash(i, mid) == self._hash(j, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts before suffix j."""
        n = self.common(i, j)
        ended = (n == self.size[i]) | (n == self.size[j])
        a = self.data[np.where(ended, 0, self.at[i] + n)]
        b = self.data[np.where(ended, 0, self.at[j] + n)]
        return np.where(ended, self.size[i] < self.size[j], a < b)

    def true_common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension, byte by byte."""
        out = np.zeros(len(i), np.int64)
        going = np.arange(len(i))
        while len(going):
            n = out[going]
            going = going[(n < self.size[i[going]]) & (n < self.size[j[going]])]
            n = out[going]
            going = going[self.data[self.at[i[going]] + n] == self.data[self.at[j[going]] + n]]
            out[going] += 1
        return out


def sort_suffixes(s: Suffixes, first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mergesort of the suffixes within each group (``first`` item, number of items).

    Returns the order and the common extension of each suffix with the one before it (0 at
    the start of a group).  All merges of a level run together: a suffix's place in the
    merged block is its place in its own half plus, by binary search, the number of suffixes
    of the other half that sort before it.
    """
    n = len(s.at)
    order = np.arange(n)
    group = np.repeat(np.arange(len(first)), many)
    begin, end = first[group], (first + many)[group]
    width = 1
    while width < many.max(initial=0):
        at = np.flatnonzero(many[group] > width)
        place = at - begin[at]
        block = begin[at] + place // (2 * width) * (2 * width)
        is_left = place // width % 2 == 0
        low = np.minimum(np.where(is_left, block + width, block), end[at])
        high = np.minimum(low + width, end[at])
        item, seen = order[at], low.copy()
        going = np.flatnonzero(seen < high)
        while len(going):
            mid = (seen[going] + high[going]) // 2
            other = order[mid]
            left = is_left[going]
            # of equal suffixes those of the left half come first
            less = np.empty(len(going), bool)
            less[left] = s.before(other[left], item[going[left]])
            less[~left] = ~s.before(item[going[~left]], other[~left])
            seen[going] = np.where(less, mid + 1, seen[going])
            high[going] = np.where(less, high[going], mid)
            going = going[seen[going] < high[going]]
        merged = order.copy()
        merged[block + place % width + seen - low] = item
        order = merged
        width *= 2
    shared = np.zeros(n, np.int64)
    next_to = np.flatnonzero(group[1:] == group[:-1]) + 1 if n else np.empty(0, int)
    shared[next_to] = s.common(order[next_to], order[next_to - 1])
    true = s.true_common(order[next_to], order[next_to - 1])
    if (true != shared[next_to]).any():  # a collision: sort by the bytes themselves
        text = [s.data[a:a + m].tobytes() for a, m in zip(s.at, s.size)]
        order = np.array(sorted(range(n), key=lambda i: (group[i], text[i])))
        true = s.true_common(order[next_to], order[next_to - 1])
    shared[next_to] = true
    return order, shared


def removable(data: np.ndarray, group: np.ndarray, doc: np.ndarray, count: np.ndarray, offset: np.ndarray,
              length: int = LENGTH) -> np.ndarray:
    """For each run a bit mask of its strings that also occur in a run of its group with a
    smaller document id.

    ``data`` holds the runs' bytes one after another, ``count`` strings each, sorted by
    ``group``; ``offset`` is the anchor's place in the run.  Two strings are equal when the
    anchor stands at the same place in both, the bytes right of it agree to the end and the
    bytes left of it agree to the start.
    """
    size = count + length - 1
    start = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
    inside = np.arange(len(data)) - np.repeat(start, size)
    first, many = runs(group)
    right = Suffixes(data, inside, start + offset, size - offset)
    right_order, right_shared = sort_suffixes(right, first, many)
    mirrored = np.repeat(size, size) - 1 - inside
    left = Suffixes(data[::-1], mirrored[::-1], len(data) - (start + offset), offset)
    left_order, left_shared = sort_suffixes(left, first, many)
    new = np.zeros(len(group), bool)
    new[first] = True

    def classes(order: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(new | (shared < depth))
        return out

    mask = np.zeros(len(group), np.uint64)
    for before in range(int(offset.max(initial=0)) + 1):  # bytes of the string left of the anchor
        string = offset - before
        have = np.flatnonzero((string >= 0) & (string < count))
        if not len(have):
            continue
        same = classes(right_order, right_shared, length - before)[have] * (len(group) + 1) \
            + classes(left_order, left_shared, before)[have]
        by = np.lexsort((doc[have], same))
        begin, total = runs(same[by])
        lowest = np.repeat(doc[have][by][begin], total)
        hit = by[doc[have][by] > lowest]
        mask[have[hit]] |= np.uint64(1) << string[have[hit]].astype(np.uint64)
    return mask


def _every_string(count: np.ndarray) -> np.ndarray:
    """The mask of all strings of runs of ``count`` strings, 1 to 64."""
    return np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - count).astype(np.uint64)


def repeated_strings(data: np.ndarray, key: np.ndarray, content: np.ndarray, doc: np.ndarray, common: np.ndarray,
                     count: np.ndarray, offset: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each run a bit mask of its strings that also occur in a run of the same ``key`` with a smaller document id.

    Of equal runs, compared byte by byte, those of the smallest id are left; what these share with the key's other
    runs is found by sorting suffixes.  ``common`` strings and runs are different groups even where their keys are equal."""
    size = count + length - 1
    start = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
    class_of, one = verified_classes(data, start, size, (common, key, content), doc)
    again = doc > doc[one][class_of]
    mask = np.where(again, _every_string(count), np.uint64(0))
    rest = np.flatnonzero(~again)
    rest = rest[np.lexsort((doc[rest], key[rest], common[rest]))]
    first, many = _groups(key[rest], common[rest])
    # a group of one document has nothing to give
    last = first + many - 1
    rest = rest[np.repeat(doc[rest][first] < doc[rest][last], many)]
    first, many = _groups(key[rest], common[rest])
    group = np.repeat(np.arange(len(first)), many)
    end = np.cumsum(size[rest])
    for a, b in _chunks(group, end):
        part = rest[a:b]
        from_ = np.concatenate(([0], np.cumsum(size[part])[:-1])).astype(np.int64)
        bytes_ = data[np.arange(int(size[part].sum())) - np.repeat(from_ - start[part], size[part])]
        mask[part] = removable(bytes_, group[a:b], doc[part], count[part], offset[part], length)
    return mask


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, how many) of rows sorted by ``keys``."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return runs(np.cumsum(new))


# --- blocks ---------------------------------------------------------------------------------


class Block:
    """One block: its documents, runs, and the classes of equal runs inside it."""

    def __init__(self, data: bytes, id_col: str, text_col: str, buckets: int, length: int, gram: int):
        self.rows = pa.ipc.open_stream(data).read_all().combine_chunks()
        text, ids = self.rows.column(text_col).cast(pa.large_binary()), self.rows.column(id_col)
        self.length = length
        self.size = pc.fill_null(pc.binary_length(text), 0).to_numpy().astype(np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)))[:-1].astype(np.int64)
        self.data = np.frombuffer(b"".join([v for v in text.to_pylist() if v]), np.uint8)
        self.usable = ids.is_valid().to_numpy()
        self.ids = ids.fill_null(0).to_numpy().astype(np.int64)
        self.runs = block_runs(self.data, self.start, self.size, self.usable, length, gram)
        self.code = ((self.runs.anchor >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) \
            | (self.runs.anchor & np.uint64(0xFFFFFFFF))
        self.codes, self.code_of = np.unique(self.code, return_inverse=True)
        self.doc = self.ids[self.runs.doc]
        # classes of equal runs: their code, smallest id and one run that has it
        self.class_of, self.one = verified_classes(self.data, self.runs.place, self.runs.count + (length - 1),
                                                   (self.code, self.runs.content), self.doc)
        self.class_code = self.code_of[self.one]
        self.class_doc = self.doc[self.one]

    def common(self) -> np.ndarray:
        """Codes with very many different runs in this block."""
        return np.bincount(self.class_code, minlength=len(self.codes)) > COMMON_SURROUNDINGS

    def status(self, found: list | None) -> np.ndarray:
        """0, 1 (occurs in another block, or with different runs of two documents here) or 2 (common) of each code,
        after pass 1."""
        out = np.zeros(len(self.codes), np.uint8)
        bucket = (self.codes >> np.uint64(32)).astype(np.int64)
        for r in found or []:
            a, b = np.searchsorted(bucket, [r["bucket"], r["bucket"] + 1])
            out[a:b] = np.frombuffer(r["status"], np.uint8)
        if len(out):
            low = np.full(len(out), np.iinfo(np.int64).max)
            high = np.full(len(out), np.iinfo(np.int64).min)
            np.minimum.at(low, self.code_of, self.doc)
            np.maximum.at(high, self.code_of, self.doc)
            several = np.bincount(self.class_code, minlength=len(out)) > 1
            out = np.maximum(out, ((low < high) & several).astype(np.uint8))
        return out

    def bytes_of(self, place: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The bytes of several stretches, one after another."""
        first = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
        return self.data[np.arange(int(size.sum())) - np.repeat(first - place, size)]

    def common_strings(self, status: np.ndarray):
        """The strings of common anchors: places, the class of each by its bytes, and per
        class one place, smallest id and hash."""
        mine = np.flatnonzero(status[self.code_of] == 2) if len(self.code_of) else np.empty(0, int)
        count = self.runs.count[mine]
        first = np.concatenate(([0], np.cumsum(count)[:-1])).astype(np.int64)
        place = np.arange(int(count.sum())) - np.repeat(first - self.runs.place[mine], count)
        doc = np.repeat(self.doc[mine], count)
        strings = self.bytes_of(place, np.full(len(place), self.length)).reshape(-1, self.length)
        _, one, kind = np.unique(strings.copy().view(f"V{self.length}").ravel(), return_index=True,
                                 return_inverse=True)
        lowest = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(lowest, kind, doc)
        power = _powers(self.length)[0][:self.length]
        hashes = _mixed((BYTE_VALUES[strings[one]] * power).sum(1, dtype=np.uint64))
        return place, doc, kind, place[one], lowest, hashes


def _split(bucket: np.ndarray, *columns: np.ndarray):
    """Yield (bucket, columns) of rows sorted by bucket."""
    for at, n in zip(*runs(bucket)):
        yield int(bucket[at]), *(c[at:at + n] for c in columns)


def _batch(rows: list[tuple], schema: T.StructType, kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names)


def _fields(spec: str) -> tuple[T.StructType, list[pa.DataType]]:
    of = {"int": (T.IntegerType(), pa.int32()), "long": (T.LongType(), pa.int64()), "binary": (T.BinaryType(), pa.binary())}
    pairs = [f.split(":") for f in spec.split()]
    return T.StructType([T.StructField(n, of[k][0]) for n, k in pairs]), [of[k][1] for _, k in pairs]


def _arrays(table: pa.Table, **kinds: str) -> list[np.ndarray]:
    """Blobs of all rows of a table, joined into arrays."""
    return [np.frombuffer(b"".join(table.column(c).to_pylist()), k) for c, k in kinds.items()]


def _chunks(group: np.ndarray, end: np.ndarray):
    """(start, stop) of whole groups with SORT_BYTES bytes at most, one group at least;
    ``end`` is where each item's bytes end."""
    last = np.flatnonzero(np.append(group[1:] != group[:-1], True)) + 1
    start, done = 0, 0
    for k, stop in enumerate(last):
        if k + 1 == len(last) or end[last[k + 1] - 1] - done > SORT_BYTES:
            yield start, stop
            start, done = stop, end[stop - 1]


def _owners(table: pa.Table, column: str, width: int) -> np.ndarray:
    """For each entry of a blob column the number of the row it came with."""
    return np.repeat(np.arange(len(table)), [len(b) // width for b in table.column(column).to_pylist()])


def blocks(docs: DataFrame, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, size, data): the rows of ``docs`` in Arrow streams, with the bytes of their
    texts, written bucketed by block."""
    spark = docs.sparkSession

    def grouped(batches):
        for batch in batches:
            size = [n or 0 for n in pc.binary_length(batch.column(text_col)).to_pylist()]
            at = 0
            while at < batch.num_rows:
                end, total = at + 1, size[at]
                while end < batch.num_rows and total + size[end] <= block_bytes:
                    total += size[end]
                    end += 1
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as stream:
                    stream.write_batch(batch.slice(at, end - at))
                yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()),
                                                  pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["size", "data"])
                at = end

    rows = docs.mapInArrow(grouped, "size long, data binary").select(
        F.monotonically_increasing_id().alias("block"), "size", "data")
    name = f"blocks_{uuid.uuid4().hex}"
    # as many buckets as shuffle partitions, so that joins by block leave the blocks in place
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(n, "block").format("parquet").option("compression", "zstd").option(
        "path", scratch_path(spark, "blocks")).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only; the files stay until the driver ends
    return table


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   gram: int = GRAM, as_text: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and kept (the remaining bytes; with
    ``as_text`` as a string, without the characters that lost some of their bytes).

    A byte is removed if it is covered by a string of ``length`` bytes that also starts in
    a document with a smaller id; strings are judged on the input.  ``id_col`` is an integer
    column; rows with a null id keep all their bytes and take none from others, and rows
    that repeat an id do not remove each other's bytes.  Null and empty texts have no bytes;
    texts of any length are whole.  Columns with the names of the added ones are replaced.
    ``block_bytes`` is the text of a block; for very large inputs larger blocks (32 MB at
    100 TB) keep the messages between blocks and groups few.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be an integer column")
    if not 8 <= gram <= length <= gram + 63:
        raise ValueError("gram must be at least 8 and at most 63 bytes shorter than length")
    added = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
             T.StructField("n_spans", T.LongType()),
             T.StructField("kept", T.StringType() if as_text else T.BinaryType())]
    docs = docs.drop(*[f.name for f in added])
    table = blocks(docs, text_col, block_bytes)
    total = table.agg(F.sum("size")).first()[0] or 0
    # 8 MB of text in a bucket at 1 GB, 370 MB at 100 TB: a block then has several anchors for a bucket, not one
    buckets = max(1, round(total / (BUCKET_BYTES * max(1, total) ** (1 / 3))))
    table = table.drop("size")

    def each_block(batches):
        """(block number, Block, what pass 1 and 2 told it) of each row."""
        for batch in batches:
            told = [batch.column(c) if c in batch.schema.names else None for c in ("one", "two")]
            for at in range(batch.num_rows):
                b = Block(batch.column("data")[at].as_buffer(), id_col, text_col, buckets, length, gram)
                yield (batch.column("block")[at].as_py(), b,
                       *(c[at].as_py() or [] if c is not None else [] for c in told))
                del b
                release_memory()

    def learnt(found: DataFrame, name: str) -> DataFrame:
        """One row per block: what the groups of a pass told it."""
        cols = [c for c in found.columns if c != "block"]
        return found.groupBy("block").agg(F.collect_list(F.struct(*cols)).alias(name)).hint("shuffle_hash")

    # pass 1: which anchors occur in other blocks, and which are common
    schema1, kinds1 = _fields("bucket:int block:long keys:binary common:binary")

    def anchors(batches):
        for number, b, *_ in each_block(batches):
            bucket = (b.codes >> np.uint64(32)).astype(np.int32)
            yield _batch([(k, number, keys.tobytes(), common.tobytes()) for k, keys, common in
                          _split(bucket, b.codes.astype("<u4"), b.common().astype(np.uint8))], schema1, kinds1)

    schema2, kinds2 = _fields("block:long bucket:int status:binary")

    def occur(t: pa.Table) -> pa.Table:
        keys, common = _arrays(t, keys="<u4", common=np.uint8)
        owner = _owners(t, "keys", 4)
        _, of, times = np.unique(keys, return_inverse=True, return_counts=True)
        often = (np.bincount(of, weights=common) > 0) | (times > COMMON_BLOCKS)
        status = np.where(often, 2, times > 1).astype(np.uint8)[of]
        number, bucket = t.column("block").to_pylist(), t.column("bucket")[0].as_py()
        return pa.Table.from_batches([_batch([(number[i], bucket, s.tobytes()) for i, s in _split(owner, status)],
                                             schema2, kinds2)])

    one = written(table.mapInArrow(anchors, schema1).groupBy("bucket").applyInArrow(occur, schema2))
    with_one = table.join(learnt(one, "one"), "block", "left")

    # pass 2: equal runs around one anchor, and what differing ones have in common
    schema3, kinds3 = _fields("bucket:int block:long key:binary content:binary doc:binary number:binary common:binary "
                              "count:binary offset:binary data:binary")

    def shared_runs(batches):
        for number, b, one, _ in each_block(batches):
            status = b.status(one)
            mine = np.flatnonzero(status[b.class_code] == 1)
            run = b.one[mine]
            _, _, _, place, lowest, hashes = b.common_strings(status)
            key = np.concatenate((b.runs.anchor[run], hashes))
            parts = (key, np.concatenate((b.runs.content[run], hashes)), np.concatenate((b.class_doc[mine], lowest)),
                     np.concatenate((mine, np.arange(len(place)))).astype("<u4"),
                     np.repeat(np.array([0, 1], np.uint8), [len(mine), len(place)]),
                     np.concatenate((b.runs.count[run], np.ones(len(place), np.int64))).astype(np.uint8),
                     np.concatenate((b.runs.offset[run], np.zeros(len(place), np.int64))).astype(np.uint8))
            from_ = np.concatenate((b.runs.place[run], place))
            bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            rows = []
            for k, where, *cols in _split(bucket[order], from_[order], *(p[order] for p in parts)):
                piece = b.bytes_of(where, cols[5].astype(np.int64) + length - 1)
                rows.append((k, number, *(c.tobytes() for c in cols), piece.tobytes()))
            yield _batch(rows, schema3, kinds3)

    schema4, kinds4 = _fields("block:long number:binary common:binary mask:binary")

    def repeated(t: pa.Table) -> pa.Table:
        key, content, doc, number, common, count, offset, data = _arrays(
            t, key="<u8", content="<u8", doc="<i8", number="<u4", common=np.uint8, count=np.uint8, offset=np.uint8,
            data=np.uint8)
        owner = _owners(t, "key", 8)
        mask = repeated_strings(data, key, content, doc, common, count.astype(np.int64), offset.astype(np.int64), length)
        blocks_of, rows = t.column("block").to_pylist(), []
        for i, n, c, m in _split(owner, number, common, mask):
            hit = m > 0
            if hit.any():
                rows.append((blocks_of[i], n[hit].tobytes(), c[hit].tobytes(), m[hit].tobytes()))
        release_memory()
        return pa.Table.from_batches([_batch(rows, schema4, kinds4)])

    two = written(with_one.mapInArrow(shared_runs, schema3).groupBy("bucket").applyInArrow(repeated, schema4))

    # pass 3: remove
    def removed(batches):
        for _, b, one, two in each_block(batches):
            yield _without(b, b.status(one), two, as_text)

    return with_one.join(learnt(two, "two"), "block", "left").mapInArrow(
        removed, T.StructType(docs.schema.fields + added))


def _without(b: Block, status: np.ndarray, two: list, as_text: bool) -> pa.RecordBatch:
    """The rows of a block with their removed bytes, counts and what is kept."""
    r, length = b.runs, b.length
    edge = np.zeros(len(b.data) + 1, np.int64)

    def cover(place: np.ndarray, size) -> None:
        np.add.at(edge, place, 1)
        np.add.at(edge, place + size, -1)

    mask = np.zeros(len(b.one), np.uint64)
    place, doc, kind, one, lowest, _ = b.common_strings(status)
    seen = np.zeros(len(one), bool)
    for row in two:
        number, common = np.frombuffer(row["number"], "<u4"), np.frombuffer(row["common"], np.uint8) == 1
        mask[number[~common]] |= np.frombuffer(row["mask"], "<u8")[~common]
        seen[number[common]] = True
    if len(r.place):
        own = status[b.code_of] < 2
        own_class = b.class_of
        whole = mask == _every_string(r.count[b.one])
        all_of = own & ((b.doc > b.class_doc[own_class]) | whole[own_class])
        cover(r.place[all_of], r.count[all_of] + length - 1)
        some = np.flatnonzero(own & ~all_of & (mask[own_class] > 0))
        for bit in range(int(r.count[some].max(initial=0))):
            hit = some[(mask[own_class[some]] >> np.uint64(bit) & np.uint64(1)) == 1]
            cover(r.place[hit] + bit, length)
        again = (doc > lowest[kind]) | seen[kind]
        cover(place[again], length)
    gone = np.cumsum(edge[:-1]) > 0
    keep = b.data[~gone].tobytes()
    ends = np.concatenate(([0], np.cumsum(gone)))
    n_removed = ends[b.start + b.size] - ends[b.start]
    rising = gone & ~np.concatenate(([False], gone[:-1])) if len(gone) else gone
    if len(gone):
        inner = b.start[(b.size > 0)]
        rising[inner] = gone[inner]
    ups = np.concatenate(([0], np.cumsum(rising)))
    n_spans = ups[b.start + b.size] - ups[b.start]
    last = np.cumsum(b.size - n_removed)
    kept = [keep[e - s:e] for e, s in zip(last, b.size - n_removed)]
    kept = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
    return pa.RecordBatch.from_arrays(
        [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in
         (b.rows.column(i) for i in range(b.rows.num_columns))]
        + [pa.array(b.size), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), kept],
        names=[*b.rows.schema.names, "n_bytes", "n_removed", "n_spans", "kept"])
