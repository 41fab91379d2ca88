"""Packing by power-of-two decomposition: no sequence holds two documents."""

from __future__ import annotations

import re
from functools import cache
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnwise.llm.common import each_text

TEXT_STEP = 1 << 20  # characters of one text that are tokenized at a time
CACHE_WORDS = 300_000  # tokenized words of one generation that a worker remembers
BATCH_PIECES = 4096  # pieces in one output batch
_CUT = regex.compile(r"(?<=\p{L}) (?=\p{L})")  # always a border between two words
_LATIN = re.compile(r"[\t\n\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]*")
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_LATIN_WORDS = re.compile(
    rf" ?[{_LETTERS}]+|'(?:[sdmt]|ll|ve|re)| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")
# Fixed rule of byte-level vocabularies: visible Latin-1 characters stand for their byte, the other bytes for
# the characters from 256 on, in order.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPACE = chr(256 + 32)
BYTE_SYMBOLS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}


class _Words(dict):
    """Ids of words by word, as little-endian unsigned 32-bit integers; new words are encoded on demand."""

    def __init__(self, model, older: dict[str, bytes]):
        super().__init__()
        self.model, self.older = model, older

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            if word.isascii() and word.isprintable():  # only spaces have another symbol
                symbols = word.replace(" ", SPACE)
            else:
                symbols = word.encode().decode("latin-1").translate(BYTE_SYMBOLS)
            found = [t.id for t in self.model.tokenize(symbols)]
            ids = pack_ids(f"<{len(found)}I", *found)
        self[word] = ids
        return ids


class WordTokenizer:
    """Byte-level BPE ids of whole texts, word by word.

    The tokenizer's own first step splits a text into words before it merges bytes, so the
    ids of a text are those of its words in turn.  Each word is encoded once and
    remembered for two generations of ``CACHE_WORDS`` words.  Texts of plain Latin
    characters are split by an equal pattern of the faster ``re`` module.  A tokenizer
    without such a step needs ``pattern``.

    With ``added`` the vocabulary's added tokens ("<|endoftext|>") are found in the text
    first, as the tokenizer does by itself; without it they are ordinary words.
    """

    def __init__(self, path: str, pattern: str, added: bool = False):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.splitter = self.tokenizer.model, self.tokenizer.pre_tokenizer
        self.pattern = regex.compile(pattern)
        self.known = _Words(self.model, {})
        tokens = self.tokenizer.get_added_tokens_decoder() if added else {}
        self.added = {t.content: pack_ids("<I", i) for i, t in tokens.items()}
        self.plain = not any(t.lstrip or t.rstrip or t.single_word for t in tokens.values())
        longest_first = sorted(self.added, key=len, reverse=True)
        self.find_added = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if tokens else None

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.find_added is None or not any(t in text for t in self.added):
            return self._word_ids(text)
        if not self.plain:  # tokens that take in their surroundings
            found = self.tokenizer.encode(text, add_special_tokens=False).ids
            return pack_ids(f"<{len(found)}I", *found)
        parts = self.find_added.split(text)  # every second one is a token
        return b"".join(self.added[p] if i % 2 else self._word_ids(p) for i, p in enumerate(parts))

    def _words(self, part: str) -> list[str]:
        if _LATIN.fullmatch(part):
            return _LATIN_WORDS.findall(part)
        if self.splitter is None:
            return self.pattern.findall(part)
        return [part[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(part)]

    def _word_ids(self, text: str) -> bytes:
        out, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + TEXT_STEP) if at + TEXT_STEP < len(text) else None
            end = cut.start() if cut else len(text)
            part = text[at:end] if at or cut else text
            out.append(b"".join(map(self.known.__getitem__, self._words(part))))
            if len(self.known) > CACHE_WORDS:
                self.known = _Words(self.model, dict(self.known))
            at = end
        return b"".join(out)


@cache
def shared_tokenizer(path: str, pattern: str, added: bool = False) -> WordTokenizer:
    """One tokenizer, with the words it remembers, for all tasks of a Python worker."""
    return WordTokenizer(path, pattern, added)


def pieces(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the power-of-two pieces of ``n`` ids, longest first."""
    out, at = [], 0
    while n - at >= longest:
        out.append((at, longest))
        at += longest
    for bit in reversed(range(longest.bit_length() - 1)):
        if (n - at) >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
         longest: int = 1024, end_id: int = 0, added: bool = False) -> DataFrame:
    """One row per packed sequence: doc_id, start, length, ids, doc_tokens, bucket, sequence_id, offset.

    Each document's ids, ``end_id`` last, are cut into as many pieces of ``longest`` ids
    (a power of two) as fit and the binary digits of the rest, so a piece is one
    sequence without padding and without a second document.  ``ids`` holds the ids as
    little-endian unsigned 32-bit integers, ``bucket`` the power of two; sequences of
    one bucket stack into batches as they are (``write_buckets``).  A null or empty text
    is the one id ``end_id``; null and repeated ids are packed like any other row.
    ``sequence_id`` numbers the pieces by input partition and row: it depends only on how
    the input is split, so a task that runs again numbers alike.  Nothing is shuffled.
    ``added`` finds the vocabulary's added tokens in the texts.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("bucket", T.IntegerType())])

    def packed(batches):
        tokens = shared_tokenizer(tokenizer_path, pattern, added)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            id_type, ids, rows = batch.column(0).type, batch.column(0), []

            def block():
                doc, at, size, data, total = zip(*rows)
                return pa.RecordBatch.from_arrays([
                    pa.array([ids[i].as_py() for i in doc], id_type), pa.array(at, pa.int64()),
                    pa.array(size, pa.int64()), pa.array(data, pa.binary()), pa.array(total, pa.int64()),
                    pa.array([s.bit_length() - 1 for s in size], pa.int32())], names=schema.names)

            for i, text in enumerate(each_text(batch.column(1))):
                data = tokens.ids(text.decode("utf-8", "replace")) + end
                n = len(data) // 4
                for at, size in pieces(n, longest):
                    rows.append((i, at, size, data[4 * at:4 * (at + size)], n))
                    if len(rows) >= BATCH_PIECES:
                        yield block()
                        rows = []
            if rows:
                yield block()

    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(packed, schema)
    return out.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write the sequences in one folder per length, ready to be read as even batches."""
    packed.write.partitionBy("bucket").parquet(path)
