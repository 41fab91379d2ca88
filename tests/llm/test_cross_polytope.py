"""Nearest neighbours: exact scores, recall against brute force, odd rows."""

import numpy as np

from churnwise.llm import cross_polytope as cp

SCHEMA = "vec_id long, embedding array<float>, code string, dim int"


def run(spark, rows, every=10, **more):
    df = spark.createDataFrame([(i, v, "c", 0) for i, v in rows], SCHEMA)
    got = cp.nearest(df, df.where(f"vec_id % {every} = 0"), **more).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def brute(rows, query, k=10):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    q = x[list(ids).index(query)]
    d = np.sqrt(((x - q) ** 2).sum(1))
    other = np.flatnonzero(ids != query)
    best = other[np.lexsort((ids[other], d[other]))][:k]
    return [(r + 1, int(ids[b]), float(d[b])) for r, b in enumerate(best)]


def data(n, dim, seed=1, scale=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if scale:
        x *= rng.uniform(0.3, 3, size=(n, 1))
    return [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]


def recall(spark, rows, **more):
    got = run(spark, rows, **more)
    want = {q: brute(rows, q) for q in got}
    true = {q: dict((v, s) for _, v, s in brute(rows, q, len(rows))) for q in list(got)[:5]}
    for q, t in true.items():
        assert all(t[v] == s for _, v, s in got[q])
        assert [r for r, _, _ in got[q]] == list(range(1, len(got[q]) + 1))
        assert [(s, v) for _, v, s in got[q]] == sorted((s, v) for _, v, s in got[q])
    return np.mean([len({v for _, v, _ in got[q]} & {v for _, v, _ in want[q]}) / len(want[q]) for q in want])


def test_recall(spark):
    assert recall(spark, data(3000, 64), every=50) >= 0.9
    assert recall(spark, data(12000, 64), every=400) >= 0.9
    assert recall(spark, data(3000, 20, scale=True), every=50) >= 0.9


def test_two_rotations_a_bucket(spark):
    assert recall(spark, data(2000, 12), every=50, hashes=2, candidates=12000) >= 0.9
    x = cp.lifted(np.array([v for _, v in data(50, 12)]), 1.0)
    one, two = cp.axes(x, 0, 3), cp.axes(x, 0, 9, hashes=2)
    assert (two[:, 0] // (2 * x.shape[1]) == one[:, 0]).all()
    assert (np.sort(two, axis=1)[:, 1:] != np.sort(two, axis=1)[:, :-1]).all()


def test_odd_rows_and_ties(spark):
    rows = [(10, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [0.0, -1.0]), (4, [2.0, 0.0]), (5, [1.0, 0.0])]
    odd = [(20, None), (30, [0.0, 0.0]), (40, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 0.0]),
           (50, [1.0, 2.0, 3.0]), (5, [1.0, 0.0])]
    got = run(spark, rows + odd)
    assert set(got) == {10}
    assert got[10] == [(1, 5, 0.0), (2, 4, 1.0), (3, 1, 2 ** 0.5), (4, 2, 2 ** 0.5), (5, 3, 2 ** 0.5)]


def test_large_bucket_is_split(spark):
    rows = [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(9000)] + [(9000 + i, v) for i, v in data(200, 4)]
    got = run(spark, rows, every=1000)
    assert all([v for _, v, _ in got[q]] == [v for v in range(11) if v != q][:10] for q in range(0, 9000, 1000))


def test_empty(spark):
    assert run(spark, []) == {}
    assert run(spark, [(10, None)]) == {}
    assert run(spark, [(10, [1.0, 1.0])]) == {}


def test_transform():
    x = np.random.default_rng(0).normal(size=(5, 8))
    h = np.array([[1]])
    for _ in range(3):
        h = np.block([[h, h], [h, -h]])
    assert np.allclose(cp.hadamard(x), x @ h)
    y = np.random.default_rng(1).normal(size=(6, 8))
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    up = cp.lifted(y * 2, 2.0)
    assert np.allclose(np.linalg.norm(up, axis=1), 1) and np.allclose(up @ up.T, y @ y.T)


def test_chance_to_meet_holds_with_more_rotations():
    """Neighbours at cosine 0.55 meet at the production tables and probes on both sides of the switch."""
    rng, m, c = np.random.default_rng(3), 60, 0.55
    q, z = rng.normal(size=(2, m, 64))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    z -= (z * q).sum(1, keepdims=True) * q
    v = c * q + (1 - c * c) ** 0.5 * z / np.linalg.norm(z, axis=1, keepdims=True)
    asked, indexed = cp.lifted(q, 1.0), cp.lifted(v, 1.0)
    last = cp.BUCKET_ROWS * 256
    for n, rotations in ((last, 1), (last + 1, 2)):
        hashes, tables, probes = cp.effort(n, 256)
        assert hashes == rotations
        met = [(cp.axes(asked, t, probes, hashes) == cp.axes(indexed, t, 1, hashes)).any(1) for t in range(tables)]
        assert np.any(met, axis=0).mean() >= 0.98


def test_nearest_pairs_of_axes():
    """The probes are the nearest of all combinations of axes."""
    x, width = cp.lifted(np.array([v for _, v in data(300, 6)]), 1.0), 16
    one = cp.axes(x, 0, 1)
    got = cp.axes(x, 0, 20, hashes=2)
    every = cp.axes(x, 0, width * width, hashes=2)
    assert (np.sort(every, axis=1) == np.arange(width * width)).all()
    assert (got == every[:, :20]).all() and (got[:, 0] // width == one[:, 0]).all()
