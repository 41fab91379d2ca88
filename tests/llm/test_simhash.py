"""SimHash near-duplicates against brute force over all pairs."""

import random
import re
from itertools import combinations

import pytest
import xxhash
from test_common_llm import union_find

from churnwise.llm import simhash


def plain(text, size=3):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=3):
    prints = [plain(t) for _, t in rows]
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= radius]
    root = union_find(links)
    low = {}
    for i, (doc, _) in enumerate(rows):
        r = root.get(i, i)
        low[r] = min((x for x in (low.get(r), doc) if x is not None), default=None)
    return sorted(((doc, f, low[root.get(i, i)]) for i, ((doc, _), f) in enumerate(zip(rows, prints))), key=str)


def texts(n=120, seed=5):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(300)]
    out = []
    for i in range(n):
        if i % 4 and out:
            base = rng.choice(out)[1].split(" ")
            for _ in range(rng.randrange(3)):
                base[rng.randrange(len(base))] = rng.choice(words)
            out.append((i, " ".join(base)))
        else:
            out.append((i, " ".join(rng.choices(words, k=rng.choice([1, 2, 3, 40, 400])))))
    return out


def test_fingerprint_rules():
    assert simhash.fingerprint(b"") == 0 == simhash.fingerprint(b" \t\n\x0b\x0c\r ")
    assert simhash.fingerprint(b"One\x0btwo") == xxhash.xxh64_intdigest(b"one two", 42)
    for t in ["A b C d", "É é x y z", "a a a a a a", "x" * 5000 + " y z w"]:
        assert simhash.fingerprint(t.encode()) == plain(t)


def test_long_text_in_steps(monkeypatch):
    text = " ".join("v%d" % (i * i % 997) for i in range(3000))
    monkeypatch.setattr(simhash, "TEXT_STEP", 100)
    assert simhash.fingerprint(text.encode()) == plain(text)
    assert simhash.fingerprint(b"   " * 100 + b"a b" + b"  " * 200) == plain("a b")


def test_matches_brute_force(spark):
    rows = texts() + [(900, None), (901, ""), (902, "  "), (903, "Same words here"), (903, "same WORDS here"),
                      (None, "same words here"), (None, None), (-4, "same words here")]
    df = spark.createDataFrame([(i, t, "fp", 1) for i, t in rows], "doc_id long, text string, fp string, component int")
    got = simhash.near_duplicates(df).collect()
    assert sorted(((r["id"], r["fp"] % (1 << 64), r["component"]) for r in got), key=str) == brute(rows)


@pytest.mark.parametrize("key_bits", [None, 4, 22])
def test_every_distance_up_to_the_radius(spark, key_bits):
    rng = random.Random(1)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        fps.add(x)
        for r in (1, 2, 3, 4, 5):
            for _ in range(12):
                fps.add(x ^ sum(1 << b for b in rng.sample(range(64), r)))
    fps = sorted(fps)
    signed = {x: x - (1 << 64) if x >> 63 else x for x in fps}
    rows = spark.createDataFrame([(signed[x],) for x in fps], "fp long")
    got = simhash.similar_links(rows, 3, len(fps), key_bits).collect()
    found = [(r["src"] % (1 << 64), r["dst"] % (1 << 64)) for r in got]
    want = union_find([(a, b) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 3])
    have = union_find(found)
    assert {x: want.get(x, x) for x in fps} == {x: have.get(x, x) for x in fps}


def test_many_near_fingerprints(spark):
    """A group with more variants than are sorted at once: all share their upper bits."""
    fps = sorted({(7 << 48) ^ (1 << i) ^ (1 << j) ^ (1 << k) for i in range(0, 48, 3) for j in range(1, 48, 3)
                  for k in range(2, 48, 5)} | {(7 << 48) ^ ((1 << 40) - 1)})
    got = simhash.similar_links(spark.createDataFrame([(x,) for x in fps], "fp long"), 3, len(fps)).collect()
    have = union_find([(r["src"], r["dst"]) for r in got])
    want = union_find([(a, b) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 3])
    assert {x: want.get(x, x) for x in fps} == {x: have.get(x, x) for x in fps}
    assert len(got) <= 60 * len(fps)


def test_even_radius(spark):
    fps = [0, 1, 3, 7, 15, 1 << 40]
    got = simhash.similar_links(spark.createDataFrame([(x,) for x in fps], "fp long"), 2, len(fps)).collect()
    root = union_find([(r["src"], r["dst"]) for r in got])
    assert [root[x] for x in fps] == [0] * 6


def test_keep_one(spark):
    rows = [(1, "a b c d"), (2, "A b c D"), (3, "other words are here now"), (3, "other words are here now"),
            (4, None), (5, ""), (None, "a b c d"), (6, "quite another text")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, low string")
    got = sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(df).where("doc_id is not null").collect())
    assert [g[0] for g in got] == [1, 3, 4, 6]
    assert simhash.keep_one(df).where("doc_id is null").count() == 1
    assert simhash.keep_one(df).columns == df.columns


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.keep_one(df).count() == 0
