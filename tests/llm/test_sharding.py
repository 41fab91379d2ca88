"""Sharding: exact sizes, gapless slots, exact draws."""

import numpy as np

from churnwise.llm import sharding


def test_matrix_has_both_margins():
    rng = np.random.default_rng(1)
    counts, sizes = [10, 0, 7, 1000, 3], [204, 204, 204, 204, 204]
    m = np.array(sharding.communication_matrix(counts, sizes, rng))
    assert (m.sum(1) == counts).all() and (m.sum(0) == sizes).all() and (m >= 0).all()


def test_hypergeometric_moments():
    rng = np.random.default_rng(2)
    for good, bad, draws in ((5, 5, 5), (100, 900, 50), (3, 0, 2), (0, 9, 4), (10 ** 10, 2 * 10 ** 10, 10 ** 9)):
        x = np.array([sharding.hypergeometric(rng, good, bad, draws) for _ in range(1500)], dtype=float)
        n = good + bad
        mean = draws * good / n
        var = mean * bad / n * (n - draws) / (n - 1)
        assert x.min() >= max(0, draws - bad) and x.max() <= min(good, draws)
        assert abs(x.mean() - mean) <= 5 * (var / len(x)) ** 0.5 + 1e-9
        assert abs(x.var() - var) <= 0.25 * var + 1e-9


def check(df, shards, **more):
    out = sharding.shard(df, shards, **more)
    rows = out.collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    n = len(rows)
    assert n == df.count()
    for s, slots in by.items():
        assert sorted(slots) == list(range(n // shards + (s < n % shards)))
    return out, rows


def test_rows_and_slots(spark):
    data = [(i, None if i % 50 == 0 else "t%d" % (i % 9), "s") for i in range(5003)] + [(None, None, None)] * 5
    df = spark.createDataFrame(data, "doc_id long, text string, slot string").repartition(7)
    out, rows = check(df, 24)
    assert out.columns == ["doc_id", "text", "shard", "slot"]
    assert sorted((r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None) == sorted(
        (d, t) for d, t, _ in data if d is not None) or sum(r["doc_id"] is None for r in rows) == 5


def test_clashing_names_and_few_rows(spark):
    df = spark.createDataFrame([(1, "a", 3), (1, "a", 3)], "block long, key string, `rank` int")
    out, rows = check(df, 24)
    assert out.columns == ["block", "key", "rank", "shard", "slot"]


def test_empty_table(spark):
    check(spark.createDataFrame([], "doc_id long, text string"), 24)


def test_shuffle_is_uniform(spark):
    df = spark.range(24000).repartitionByRange(6, "id")
    _, rows = check(df, 4, seed=7)
    first = np.zeros((6, 4))
    for r in rows:
        first[r["id"] // 4000, r["shard"]] += 1
    assert abs(first - 1000).max() < 6 * (4000 * 0.25 * 0.75) ** 0.5
    slots = np.array([r["slot"] for r in sorted(rows, key=lambda r: r["id"])], float)
    assert abs(np.corrcoef(np.arange(24000), slots)[0, 1]) < 0.04


def test_plan_is_native(spark):
    import contextlib
    import io
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        sharding.shard(spark.range(100), 4).explain()
    assert not [w for w in ("Python", "Pandas", "Arrow", "ExistingRDD") if w in text.getvalue()]
