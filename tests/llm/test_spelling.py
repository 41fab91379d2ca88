"""Spelling variants against all deletions of all words."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from churnwise.llm import spelling
from churnwise.llm.queries import QUERIES
from conftest import SF_SMALL


def brute_words(rows, divisor=97, least_length=5, least_count=3):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % divisor == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= least_length and n >= least_count}


def brute_near(words):
    by_deletion = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by_deletion[i, w[:i] + w[i + 1:]].add(w)
    near = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1:]
            near[w] |= by_deletion[i, rest] - {w}
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    return near


def brute(rows, **how):
    words = brute_words(rows, **how)
    near = brute_near(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def result(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_registered_query(spark):
    t = pq.read_table(f"{SF_SMALL}/documents.parquet", columns=["doc_id", "text"])
    wanted = brute(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))
    assert sum(w[5] is not None for w in wanted) > 50
    assert result(QUERIES["op13_spelling"](spark, SF_SMALL)) == wanted


def crowd(seed, n, letters="abé", low=5, high=9):
    r = random.Random(seed)
    words = ["".join(r.choice(letters) for _ in range(r.randrange(low, high))) for _ in range(n)]
    return [(i, " ".join(r.choices(words, k=60))) for i in range(40)]


@pytest.mark.parametrize("chunk", [3, 20, 1024])
def test_groups_cut_into_chunks(spark, chunk):
    rows = crowd(chunk, 500)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(spelling.spelling_variants(docs, chunk=chunk)) == brute(rows)


def test_other_parameters(spark):
    rows = crowd(4, 200, "abc", 1, 7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    how = dict(divisor=3, least_length=2, least_count=1)
    assert result(spelling.spelling_variants(docs, **how)) == brute(rows, **how)


def test_odd_rows(spark):
    long_run = "z" * 300 + "é" + "y" * 300
    rows = [(None, "ÀÉéà ÀÉéàÿ " * 4), (1, None), (2, ""), (3, "naïve×÷ naïve×÷ naïve×÷ Naïve"), (4, "don't won't Ābcdefg x1abcde2abcde"),
            (5, f"{long_run} {long_run[1:]} " * 3), (5, "same words " * 5), (5, "same words " * 5), (6, "Ünïcode " * 3 + "ünïcode " * 3),
            (7, "hello " * 9 + "hallo " * 4 + "hullo " * 4 + "hell " * 50 + "helloo " * 3)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    got = result(spelling.spelling_variants(docs))
    assert got == brute(rows)
    assert {r[0]: r[1] for r in got}["hallo"] == "hello"
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_chains_lead_to_their_end(spark):
    forms = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(40)], "word string, form string")
    assert {r["root"] for r in spelling.roots(forms).collect()} == {"w40"}


def test_run_hashes():
    texts = [b"a", b"abc" * 30, b"", b"x" * 64, b"y" * 65]
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    begin = np.cumsum(size) - size
    prefix = np.array([zlib.crc32(b"%d:" % i) for i in range(5)], np.uint32)
    assert spelling.run_hashes(data, begin, size, prefix).tolist() == [
        zlib.crc32(b"%d:" % i + t) for i, t in enumerate(texts)]
