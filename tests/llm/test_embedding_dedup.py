"""Product-quantised near-duplicates against all pairs."""

import numpy as np
from test_common_llm import union_find

from churnwise.llm import embedding_dedup as ed


def rows_of(seed=1, n=260, dim=16):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        if i % 3 and out:
            base = np.array(out[rng.integers(len(out))][1])
            v = base + rng.normal(size=dim) * rng.choice([0, 0.02, 0.05, 0.08])
            label = out[rng.integers(len(out))][2] if rng.random() < 0.2 else None
            label = label if label is not None else int(i % 2)
        else:
            v, label = rng.normal(size=dim) * rng.choice([0.1, 1, 50]), int(rng.integers(2))
        out.append((i * 7 % 1000, [float(np.float32(x)) for x in v], label))
    return out


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def brute(rows):
    links, count = [], [0] * len(rows)
    for i, (a, v, l) in enumerate(rows):
        for j, (b, w, m) in enumerate(rows[:i]):
            if l is None or l != m or not usable(v) or not usable(w) or len(v) != len(w) or a is None or b is None:
                continue
            x, y = np.array(v), np.array(w)
            if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links.append((a, b))
                count[i] += 1
                count[j] += 1
    root = union_find(links)
    return sorted(((a, c, root.get(a, a)) for (a, _, _), c in zip(rows, count)), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(i, v, l, "list", "codes") for i, v, l in rows],
                               "vec_id long, embedding array<float>, label int, list string, codes string")
    return sorted(((r["id"], r["n_links"], r["component"]) for r in ed.link(df).collect()), key=str)


def test_matches_brute_force(spark):
    rows = rows_of()
    one = [1.0] * 16
    rows += [(2001, None, 1), (2002, [0.0] * 16, 1), (2003, [float("nan")] + one[1:], 1), (2004, [None] + one[1:], 1),
             (2005, one, None), (2006, one, None), (2007, one, 1), (2008, one, 1), (2009, [2.0] * 16, 1),
             (2010, [1.0, 1.0], 1), (2011, [1.0, 1.0], 1), (2012, [float("inf")] + one[1:], 0), (2013, [], 0),
             (2014, one, 0), (None, one, 1)]
    want = brute(rows)
    assert run(spark, rows) == want
    assert sum(c for _, c, _ in want) > 100


def test_many_lists_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ed, "LIST_ROWS", 16)
    monkeypatch.setattr(ed, "BLOCK_ROWS", 20)
    rows = rows_of(3, 400)
    assert run(spark, rows) == brute(rows)


def test_bounds_hold():
    rng = np.random.default_rng(5)
    x = ed.unit(rng.normal(size=(600, 16)))
    q = ed.fit(x, 12)
    own = q.lists(x)
    codes, error = q.encode(x, own)
    probes = q.probes(x, own, 0.6)
    true = np.linalg.norm(x[:, None] - x[None], axis=2)
    assert all(probes[i, own[j]] for i, j in zip(*np.nonzero(true <= 0.6)))
    for of in range(12):
        mine = np.flatnonzero(own == of)
        d = q.distances(x, of, codes[mine])
        assert (d - error[mine][None] <= true[:, mine] + 1e-9).all()


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, 1)]) == [(1, 0, 1)]
