"""Registered queries on the whole small tables against plain recomputation of their contracts."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from churnwise.llm.queries import QUERIES, tokenizer
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}


def test_op4_pieces_are_those_of_plain_encoding(spark, docs):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer()[0])
    got = defaultdict(list)
    rows = QUERIES["op4_packing"](spark, SF_SMALL).collect()
    for r in rows:
        got[r["doc_id"]].append(r)
    assert set(got) == set(docs) and len({r["sequence_id"] for r in rows}) == len(rows)
    for doc, text in docs.items():
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for r in sorted(got[doc], key=lambda r: r["start"]):
            assert (r["start"], r["offset"], r["doc_tokens"]) == (at, 0, len(ids))
            assert r["length"] == 1 << r["bucket"] <= 1024
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:at].tobytes())
        assert at == len(ids)
        lengths = [r["length"] for r in got[doc] if r["length"] < 1024]
        assert len(lengths) == len(set(lengths))  # the binary digits of the rest


def test_op5_places_every_row_once(spark, docs):
    rows = QUERIES["op5_sharding"](spark, SF_SMALL).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    slots = defaultdict(list)
    for r in rows:
        text = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 8, zlib.crc32(text))
        assert r["law"] == "rows" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1


def _plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [words] if len(words) < 3 else [words[i:i + 3] for i in range(len(words) - 2)]
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op8_fingerprints_and_components(spark, docs):
    ids = sorted(docs)
    fp = np.array([_plain_fingerprint(docs[i]) for i in ids], dtype=np.uint64)
    root = np.arange(len(ids))
    near = [np.flatnonzero(np.bitwise_count(fp ^ f) <= 3) for f in fp]
    while True:
        low = np.array([root[n].min() for n in near])
        if (low == root).all():
            break
        root = low
    want = {i: (f"{int(f):016x}", ids[r]) for i, f, r in zip(ids, fp, root)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op8_simhash"](spark, SF_SMALL).collect()}
    assert got == want


def test_op10_nearest_rows(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    got = defaultdict(list)
    for r in QUERIES["op10_nearest"](spark, SF_SMALL).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == sorted(i for i in ids if i % 100 == 0)
    hits = 0
    for q, found in got.items():
        found.sort()
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        assert [f[0] for f in found] == list(range(1, min(10, len(ids) - 1) + 1))
        assert all(v != q and s == pytest.approx(d[ids == v][0], abs=1e-12) for _, v, s in found)
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        order = np.lexsort((ids, d))
        best = [i for i in ids[order] if i != q][:10]
        hits += len({v for _, v, _ in found} & set(best))
    assert hits >= 0.9 * sum(map(len, got.values()))
