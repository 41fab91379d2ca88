"""Packing: exact round trip against the tokenizer itself."""

import random
import zlib

import numpy as np
import pytest

from churnwise.llm import packing
from churnwise.llm.queries import tokenizer


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer()[0])
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_word_ids_are_the_tokenizers(whole):
    words, rng = packing.WordTokenizer(*tokenizer()), random.Random(1)
    letters = "ab Z'stlvre\n\t\r  0129_.,!é×÷ß²½Ⅷ٣中文́\x1c\x1f\x85\xa0 😀<|endoftext|>\x00\x7f"
    for _ in range(5000):
        s = "".join(rng.choice(letters) for _ in range(rng.randrange(20)))
        assert list(np.frombuffer(words.ids(s), "<u4")) == whole(s), repr(s)


def test_long_text_in_steps_and_forgotten_words(whole, monkeypatch):
    monkeypatch.setattr(packing, "TEXT_STEP", 64)
    monkeypatch.setattr(packing, "CACHE_WORDS", 20)
    words = packing.WordTokenizer(*tokenizer())
    text = " ".join("word%d, été's" % (i % 57) for i in range(500)) + "x" * 1000 + "\n\n  end"
    assert list(np.frombuffer(words.ids(text), "<u4")) == whole(text)


def test_pieces():
    for n in (1, 2, 1023, 1024, 1025, 5000):
        got = packing.pieces(n, 1024)
        assert sum(size for _, size in got) == n
        assert all(size & (size - 1) == 0 and size <= 1024 for _, size in got)
        assert [at for at, _ in got] == list(np.cumsum([0] + [s for _, s in got])[:-1])
    assert packing.pieces(5, 1) == [(i, 1) for i in range(5)]


def test_round_trip(spark, whole):
    rows = [(1, "Hello world, some text. " * 300), (2, None), (3, ""), (3, "twice"), (3, "twice"), (None, "no id"),
            (4, "ünïcode 中文 \x00"), (5, "a" * 5000), (6, "<|endoftext|>")]
    df = spark.createDataFrame([(i, t, 7, "ids") for i, t in rows], "doc_id long, text string, start int, ids string")
    got = packing.pack(df, *tokenizer(), longest=256).collect()
    assert len({r["sequence_id"] for r in got}) == len(got) and {r["offset"] for r in got} == {0}
    assert all(len(r["ids"]) == 4 * r["length"] and r["length"] == 1 << r["bucket"] <= 256 for r in got)
    docs, at = [], 0
    for r in sorted(got, key=lambda r: r["sequence_id"]):
        if r["start"] == 0:
            docs.append((r["doc_id"], b""))
        assert r["start"] * 4 == len(docs[-1][1])
        docs[-1] = (docs[-1][0], docs[-1][1] + r["ids"])
        if len(docs[-1][1]) == 4 * r["doc_tokens"]:
            at += 1
    want = [(i, np.array(whole(t or "") + [0], "<u4").tobytes()) for i, t in rows]
    assert sorted(docs, key=str) == sorted(want, key=str) and at == len(rows)


def test_bytes_that_are_no_text(spark, whole):
    df = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    got = packing.pack(df, *tokenizer()).orderBy("start").collect()
    assert b"".join(r["ids"] for r in got) == np.array(whole("a\ufffdb") + [0], "<u4").tobytes()


def test_query_digests(spark):
    from churnwise.llm.queries import QUERIES
    from conftest import SF_SMALL
    got = QUERIES["op4_packing"](spark, SF_SMALL).collect()
    assert {zlib.crc32(b"")} & {r["ids_crc32"] for r in got} == set()
    assert spark.read.parquet(f"{SF_SMALL}/documents.parquet").count() == len({r["doc_id"] for r in got})


def test_buckets_and_bad_length(spark, tmp_path):
    df = spark.createDataFrame([(1, "some words to pack here")], "doc_id long, text string")
    packing.write_buckets(packing.pack(df, *tokenizer()), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {1 << r["bucket"] for r in back.collect()} == {r["length"] for r in back.collect()}
    with pytest.raises(ValueError):
        packing.pack(df, *tokenizer(), longest=1000)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), *tokenizer()).count() == 0


def test_ids_are_those_of_plain_encoding(spark):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer()[0])
    words, rng = packing.WordTokenizer(*tokenizer(), added=True), random.Random(2)
    some = ["<|endoftext|>", "<|endoftext|", " ", "  ", "a", "'s", "12", "\n", "\u0558", "\u208f", "\U00010940", "中", "é"]
    texts = ["a <|endoftext|> b", "<|endoftext|>" * 3, "".join(map(chr, range(0x530, 0x590)))]
    texts += ["".join(rng.choice(some) for _ in range(rng.randrange(12))) for _ in range(2000)]
    texts += ["a%s b%s1 %s" % (chr(c), chr(c), chr(c)) for c in range(0x20000) if not 0xd800 <= c < 0xe000]
    for s in texts:
        assert list(np.frombuffer(words.ids(s), "<u4")) == t.encode(s, add_special_tokens=False).ids, repr(s)
    df = spark.createDataFrame([(1, texts[0])], "doc_id long, text string")
    got = packing.pack(df, *tokenizer(), added=True).orderBy("start").collect()
    assert b"".join(r["ids"] for r in got) == np.array([64, 220, 50256, 275, 0], "<u4").tobytes()
