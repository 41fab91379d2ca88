"""Removal of repeated strings against brute force over every string."""

import random

import numpy as np
import pytest

from churnwise.llm import suffix_dedup as sd


def brute(rows, length=50):
    """(id, n_bytes, n_removed, n_spans, kept) by a table of every string."""
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        for p in range(len(data) - length + 1) if doc is not None else ():
            w = data[p:p + length]
            first[w] = min(doc, first.get(w, doc))
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1) if doc is not None else ():
            if first[data[p:p + length]] < doc:
                gone[p:p + length] = b"\1" * length
        spans = sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1]))
        out.append((doc, len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g)))
    return sorted(out, key=str)


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(i, t, "kept", 1) for i, t in rows], "doc_id long, text string, block string, kept int")
    out = sd.remove_repeats(df.repartition(parts))
    assert out.columns == ["doc_id", "text", "block", "n_bytes", "n_removed", "n_spans", "kept"]
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out.collect()),
                  key=str)


def passages(seed=1, n=90):
    rng = random.Random(seed)
    words = [w for w in ("the of and tion er éa ing über straße 中文 x yz lorem ipsum dolor sit amet").split()]
    shared = [" ".join(rng.choices(words, k=k)) for k in (5, 12, 20, 40, 80)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            parts.append(rng.choice(shared)[rng.randrange(8):] if rng.random() < 0.4
                         else " ".join("%s%d" % (w, rng.randrange(9)) for w in rng.choices(words, k=rng.randrange(30))))
        text = " ".join(parts)
        if rows and rng.random() < 0.3:
            old = rng.choice(rows)[1] or ""
            text = old if rng.random() < 0.5 else old[:len(old) // 2] + "#" + old[len(old) // 2 + 1:]
        rows.append((rng.randrange(-5, 10 ** 6), text))
    return rows


def test_matches_brute_force(spark):
    rows = passages() + [(7, None), (8, ""), (None, "a" * 200), (1, "a" * 200), (2, "a" * 120), (3, "ab" * 60),
                         (4, "ba" * 61), (5, "x" * 49), (6, "x" * 49), (9, "La " * 70), (10, "o La " + "La " * 50)]
    rows += [(50, "repeated id " * 9), (50, "repeated id " * 9), (50, "other repeated id " * 9)]
    assert run(spark, rows) == brute(rows)


def test_alphabet_of_two(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(20))) * rng.randrange(1, 40)) for i in range(60)]
    assert run(spark, rows, 5) == brute(rows)


def test_passage_with_many_surroundings(spark):
    """More than COMMON_SURROUNDINGS different runs of one anchor in a block."""
    rng = random.Random(6)
    passage = "a passage that every one of these documents has word for word, and that is long enough"
    rows = [(i, "".join(chr(97 + rng.randrange(26)) for _ in range(rng.randrange(60, 90))) + passage
             + "".join(chr(97 + rng.randrange(26)) for _ in range(rng.randrange(60, 90)))) for i in range(200, 0, -1)]
    assert run(spark, rows, 1) == brute(rows)
    assert run(spark, rows, 4) == brute(rows)


def test_empty_table_and_bad_columns(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(TypeError):
        sd.remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_long_document_in_slices(monkeypatch):
    monkeypatch.setattr(sd, "SLICE_BYTES", 300)
    rng = random.Random(9)
    text = bytes(rng.randrange(97, 100) for _ in range(5000))
    size = np.array([40, 5000, 60])
    data = np.frombuffer(b"z" * 40 + text + b"y" * 60, np.uint8)
    r = sd.block_runs(data, np.array([0, 40, 5040]), size, np.array([True, True, True]))
    places = np.concatenate([np.arange(p, p + c) for p, c in zip(r.place, r.count)])
    assert sorted(places) == [*range(40, 40 + 4951), *range(5040, 5051)]


def test_sorted_like_python():
    rng = random.Random(2)
    pieces = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 30))).encode() for _ in range(300)]
    size = np.array([len(p) for p in pieces])
    at = np.concatenate(([0], np.cumsum(size)[:-1]))
    many = np.array([1, 99, 150, 50])
    first = np.concatenate(([0], np.cumsum(many)[:-1]))
    s = sd.Suffixes(np.frombuffer(b"".join(pieces), np.uint8), np.arange(size.sum()) - np.repeat(at, size), at, size)
    order, shared = sd.sort_suffixes(s, first, many)
    for f, m in zip(first, many):
        got = [pieces[i] for i in order[f:f + m]]
        assert got == sorted(pieces[f:f + m])
        assert shared[f] == 0
        for k in range(f + 1, f + m):
            a, b = pieces[order[k - 1]], pieces[order[k]]
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            assert shared[k] == n


@pytest.mark.parametrize("collide", [False, True])
def test_collisions_are_verified(monkeypatch, collide):
    """With a hash under which everything collides the bytes still decide."""
    if collide:
        monkeypatch.setattr(sd, "BYTE_VALUES", np.zeros(256, np.uint64))
    rng = random.Random(8)
    anchor = b"sixteen bytes 16"
    runs_, docs, count, offset = [], [], [], []
    for d in range(40):
        before, after = rng.randrange(0, 35), rng.randrange(0, 35)
        c = max(1, min(35, before + after + 16 - 49))
        body = bytes(rng.choice(b"ab") for _ in range(before)) + anchor + bytes(rng.choice(b"ab") for _ in range(34))
        c = min(35, len(body) - 49, before + 1)
        runs_.append(body[:c + 49])
        docs.append(rng.randrange(30))
        count.append(c)
        offset.append(before)
    mask = sd.removable(np.frombuffer(b"".join(runs_), np.uint8), np.zeros(40, np.int64), np.array(docs),
                        np.array(count), np.array(offset))
    first = {}
    for r, d, c in zip(runs_, docs, count):
        for s in range(c):
            first[r[s:s + 50]] = min(d, first.get(r[s:s + 50], d))
    want = [sum(1 << s for s in range(c) if first[r[s:s + 50]] < d) for r, d, c in zip(runs_, docs, count)]
    assert mask.tolist() == want


def test_kept_text_drops_broken_characters(spark):
    shared = "passage that both have, of more than fifty bytes in all "
    rows = [(1, "\u00e9" + shared + "\u00e9"), (2, "\u00e8" + shared + "\u00e8")]  # their last bytes differ
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["kept"] for r in sd.remove_repeats(df, as_text=True).collect()}
    assert got == {1: rows[0][1], 2: "\u00e8"}
    half = spark.createDataFrame([(1, shared + "\u00e9"), (2, shared + "\u00e8"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["kept"] for r in sd.remove_repeats(half, as_text=True).collect()}
    assert got == {1: shared + "\u00e9", 2: "", 3: ""}


def test_runs_whose_hashes_collide():
    """Runs of one hash and other bytes are other classes, and what is removed does not depend on the hashes."""
    rng = np.random.default_rng(8)
    texts = [bytes(rng.integers(97, 99, 60).astype(np.uint8)) for _ in range(6)]
    texts = [texts[i] for i in rng.integers(0, 6, 40)] + [texts[0][:55], texts[0][:55] + b"#####"]
    size = np.array([len(t) for t in texts])
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    data = np.frombuffer(b"".join(texts), np.uint8)
    doc = rng.permutation(len(texts))
    nothing = np.zeros(len(texts), np.uint64)
    class_of, one = sd.verified_classes(data, start, size, (nothing, nothing), doc)
    for i, t in enumerate(texts):
        assert texts[one[class_of[i]]] == t and doc[one[class_of[i]]] == min(
            d for d, u in zip(doc, texts) if u == t)
    assert len(one) == len(set(texts))

    count, offset = size - 49, np.full(len(texts), 10)  # every string of a run holds the anchor
    found = [sd.repeated_strings(data, nothing, content, doc, np.zeros(len(texts), np.uint8), count, offset)
             for content in (nothing, np.array([hash(t) & (2 ** 63 - 1) for t in texts], np.uint64))]
    assert (found[0] == found[1]).all()
    for i, t in enumerate(texts):
        smaller = [texts[j] for j in range(len(texts)) if doc[j] < doc[i]]
        assert bool(found[0][i] & np.uint64(1)) == any(u[:50] == t[:50] for u in smaller)
        if t in smaller:
            assert found[0][i] == (1 << int(count[i])) - 1


def test_equal_bytes_to_the_last():
    data = np.frombuffer(b"abcdefghijklmnopqrst" + b"abcdefghijklmnopqrsX" + b"abcdefgh", np.uint8)
    one, other = np.array([0, 0, 0, 0]), np.array([20, 20, 40, 0])
    assert sd.equal_bytes(data, one, other, np.array([20, 19, 8, 20])).tolist() == [False, True, True, True]
    none = np.empty(0, np.int64)
    assert sd.equal_bytes(np.empty(0, np.uint8), none, none, none).tolist() == []


def test_strings_on_which_the_hashes_are_weak(spark):
    """Thue-Morse strings and their complements agree in many low bits of a polynomial modulo 2^64."""
    bits = "".join("ab"[bin(i).count("1") % 2] for i in range(512))
    other = bits.translate(str.maketrans("ab", "ba"))
    rows = [(1, bits), (2, other), (3, other + bits), (4, bits[7:300]), (5, other[64:] + "c" + bits[:64])]
    assert run(spark, rows) == brute(rows)
