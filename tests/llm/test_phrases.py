"""Phrase mining against plain counting of every phrase."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from churnwise.llm import phrases

SMALL = dict(least=3, covered=80, reported=40)


def brute(rows, least, covered, reported, longest=4):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    cand = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    inside = Counter()
    for (lang, p), a in cand.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                inside[lang, p[i:i + size]] = max(inside[lang, p[i:i + size]], a)
    out = {}
    for (lang, p), a in cand.items():
        if 100 * inside[lang, p] >= covered * a:
            continue
        score, k, l, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]])
                             for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -score) for lang, found in out.items()
                  for i, (score, a, p, l, r) in enumerate(sorted(found)[:reported]))


def table(spark, rows):
    return spark.createDataFrame([(lang, text, "x", 1) for lang, text in rows],
                                 "lang string, text string, phrase string, n int")


def made(seed, n, vocabulary=12):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "Ab", "a b", "x\x00"]
    return [(r.choice(["en", "de", None, "und"]), "".join(r.choice(words) + r.choice([" ", "  ", "\t", " ", ". ", "\r\n", "!"])
                                                          for _ in range(r.randrange(60)))) for _ in range(n)]


@pytest.mark.parametrize("shards,block", [(4, 1 << 22), (3, 200), (1, 200), (6, 1000)])
def test_against_brute_force(spark, shards, block):
    rows = made(shards, 60) + [("en", "one two three four five " * 40), ("en", None), ("en", ""), (None, "?!")]
    got = phrases.collocations(table(spark, rows), shards=shards, block_bytes=block, **SMALL)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, **SMALL)


def test_crowded_table_of_reached_phrases(spark):
    """Hashes that collide only add work."""
    rows = made(9, 60)
    got = phrases.collocations(table(spark, rows), shards=2, block_bytes=300, table_slots=(8, 8), **SMALL)
    assert sorted(map(tuple, got.collect())) == brute(rows, **SMALL)


def test_sql_twin_on_odd_rows(spark):
    rows = made(5, 80, 4) + [("en", "a b " * 50)] * 3
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (lang VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(a, b.replace("\x00", "0")) for a, b in rows])
    assert sorted(con.execute(phrases.collocations_sql(**SMALL)).fetchall()) == brute(
        [(a, b.replace("\x00", "0")) for a, b in rows], **SMALL)


def test_empty_tables(spark):
    for rows in ([], [("en", None), ("en", "")]):
        assert phrases.collocations(table(spark, rows), shards=2).count() == 0


def test_each_phrase_is_counted_for_one_circle():
    """A phrase activated in the middle of a circle is counted in every shard once."""
    import pyarrow as pa
    units = pa.table({"lang": ["en", "en"], "word": pa.array([b"a", b"b"])})
    seq = np.array([0, 1, 0, 1, -1, 0], np.int32)
    one = phrases._hashes(units)
    seen, all_possible = [], np.full((4, 1 << 13), 255, np.uint8)
    for step in range(9):
        reached = np.full(1 << 16, phrases.NEVER, np.uint8)
        reached[one & np.uint64(0xFFFF)] = [1, 2]  # the second word was common after scan 2
        seen.append({(r["words"], r["phrase"]): r["n"] for b in phrases.count_block(units, seq, step, 4, reached, all_possible, 4)
                     for r in b.to_pylist()})
    assert [s.get((2, b"a b")) for s in seen] == [None, None, None, 2, 2, 2, 2, None, None]
    assert [s.get((1, b"a")) for s in seen] == [3, 3, 3, 3, None, None, None, None, None]


def test_slot_reached_by_another_phrase_first():
    """Where the slot of "a b" is reached before its words are, "a b c" still gets its full circle."""
    import pyarrow as pa
    units = pa.table({"lang": ["en"] * 3, "word": pa.array([b"a", b"b", b"c"])})
    seq = np.array([0, 1, 2], np.int32)
    hashes, mask = phrases._hashes(units), np.uint64(0xFFFF)
    pairs = next(hashed for size, hashed, _ in phrases.phrase_hashes(seq, hashes, 2) if size == 2)
    all_possible = np.full((4, 1 << 13), 255, np.uint8)
    found = []
    for step in range(9):
        reached = np.full(1 << 16, phrases.NEVER, np.uint8)
        for slots, at in ((pairs, 0), (hashes, 2)):  # a scan sees what was reached in the scans before it
            if at < step:
                reached[slots & mask] = at
        found.append([r["n"] for b in phrases.count_block(units, seq, step, 4, reached, all_possible, 4)
                      for r in b.to_pylist() if r["phrase"] == b"a b c"])
    assert found == [[], [], [], [1], [1], [1], [1], [], []]


@pytest.mark.parametrize("seed", [2, 3])
def test_rare_words_in_a_crowded_table(spark, seed):
    """Words that become common scan by scan, beside longer phrases that share their slots."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    rows = [(r.choice(["en", "de"]), " ".join(r.choices(words, [1 / (i + 1) for i in range(40)], k=r.randrange(5, 40))))
            for _ in range(60)]
    got = phrases.collocations(table(spark, rows).repartition(3), block_bytes=200, table_slots=(64, 64),
                               least=3, covered=80, reported=2000)
    assert sorted(map(tuple, got.collect())) == brute(rows, 3, 80, 2000)
