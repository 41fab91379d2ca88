"""Best-fit packing against plain tokenizing and the laws of a packing."""

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from churnwise.llm import best_fit
from churnwise.llm.queries import QUERIES, tokenizer
from conftest import SF_SMALL


def wanted_pieces(docs, longest=1024, end_id=2):
    """(doc_id, piece, start, length, ids_crc32) by plain encoding of whole texts."""
    model = Tokenizer.from_file(tokenizer()[0])
    out = []
    for doc_id, text in docs:
        ids = model.encode(text or "", add_special_tokens=False).ids + [end_id]
        first = len(ids) % longest or longest if len(ids) > longest else len(ids)
        edges = [0, *range(first, len(ids) + 1, longest)]
        for piece, (a, b) in enumerate(zip(edges, edges[1:])):
            out.append((doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return out


def check_packing(rows, longest):
    """Rows have sequence_id, offset, length; every sequence is gapless and at most ``longest``."""
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= longest
    return len(sequences)


def test_registered_query(spark):
    t = pq.read_table(f"{SF_SMALL}/documents.parquet", columns=["doc_id", "text"])
    got = QUERIES["op11_best_fit"](spark, SF_SMALL).collect()
    wanted = wanted_pieces(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(wanted)
    assert check_packing(got, 1024) <= 1.03 * sum(w[3] for w in wanted) / 1024 + 1


def test_best_fit_takes_the_fullest_bin():
    first, offset, fill = best_fit.best_fit(np.array([5, 6, 4, 3, 2]), 10)
    assert first.tolist() == [0, 1, 1, 0, 0]  # 6, then 5, then 4 into the 6, 3 and 2 into the 5
    assert offset.tolist() == [0, 0, 6, 5, 8]
    assert fill.tolist() == [10, 10, 10, 10, 10]


@pytest.mark.parametrize("sizes", [[60] * 500, [10] * 500 + [90] * 500, list(range(1, 100)) * 11, [100] * 20, [1]])
def test_rounds(spark, sizes):
    pieces = spark.createDataFrame([(i * 7, n) for i, n in enumerate(sizes)], "item long, length long")
    placed = best_fit.place(pieces, longest=100, group_items=256).join(pieces, "item").collect()
    assert sorted(r["item"] for r in placed) == sorted(i * 7 for i in range(len(sizes)))
    bins = check_packing(placed, 100)
    _, offset, _ = best_fit.best_fit(np.array(sizes), 100)
    assert bins <= 1.03 * (offset == 0).sum() + 1  # nearly as few as best fit over all


def test_odd_rows(spark):
    rows = [(1, None, "x"), (1, "", "x"), (1, "", "x"), (None, "a b", "x"), (2, "word " * 3000, None),
            (3, "<|endoftext|>", "x"), (4, "é" * 50, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumns(
        {"piece": F.lit("p"), "item": F.lit("i"), "sequence_id": F.lit("s"), "length": F.lit("l")})
    got = best_fit.pack(docs, *tokenizer()).collect()
    wanted = wanted_pieces([(r[0], r[1]) for r in rows])
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], zlib.crc32(r["ids"])) for r in got), key=key
                  ) == sorted(wanted, key=key)
    check_packing(got, 1024)
    assert best_fit.pack(docs.limit(0), *tokenizer()).count() == 0


def test_written_sequences(spark, tmp_path):
    docs = spark.createDataFrame([(i, "some words " * i) for i in range(40)], "doc_id long, text string")
    packed = best_fit.pack(docs, *tokenizer(), longest=64)
    best_fit.write_sequences(packed, str(tmp_path / "s"), 50256, longest=64)
    back = {r["sequence_id"]: r for r in spark.read.parquet(str(tmp_path / "s")).collect()}
    for r in packed.collect():
        whole = back[r["sequence_id"]]
        assert len(whole["ids"]) == 256 and r["doc_id"] in whole["doc_ids"]
        assert whole["ids"][4 * r["offset"]:4 * (r["offset"] + r["length"])] == r["ids"]
