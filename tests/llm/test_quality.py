"""Quality: features, shrinkage against numpy, decisions on labelled rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnwise.llm import quality as q
from churnwise.llm.queries import QUERIES, section

SF = "/root/testdata/sf0.01"


def test_features(monkeypatch):
    f = dict(zip(q.FEATURES, q.features(b"AB cd cd cd\n12 !# cd")))
    assert f["upper"] == 2 / 10 and f["digit"] == 2 / 20 and f["symbols"] == 2 / 20 and f["repeats"] == 2 / 7
    assert q.features(b"")[:5] == [0] * 5
    text = b"La La La, some ##Words 12 " * 50
    whole = q.features(text)
    monkeypatch.setattr(q, "TEXT_STEP", 64)
    assert np.allclose(q.features(text), whole)


def test_labelled_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = QUERIES["op3_quality"](spark, SF).join(labels, "doc_id").collect()
    assert len(rows) == labels.count()
    assert np.mean([r["keep"] == (r["quality"] == 1) for r in rows]) > 0.99
    assert all(r["keep"] for r in rows if r["quality"] == 1)


def test_rates_shrink(spark):
    rng = np.random.default_rng(1)
    rows = []
    for host, n, mean in (("big", 400, 0.9), ("bad", 300, 0.2), ("one", 1, 0.0), ("mid", 50, 0.6)):
        rows += [(host, "/%d" % (i % 3), float(np.clip(rng.normal(mean, 0.05), 0, 1))) for i in range(n)]
    df = spark.createDataFrame(rows, "host string, path string, p double")
    got = {(r["host"], r["path"]): r for r in q.site_rates(q.site_sums(df)).collect()}
    p = np.array([r[2] for r in rows])
    prior = p.mean()
    by_host = {h: np.array([x for a, _, x in rows if a == h]) for h in ("big", "bad", "one", "mid")}

    def strength(groups, centre):
        n = np.array([g[0] for g in groups], float)
        s = np.array([g[1] for g in groups])
        c = np.array(centre)
        mean_var = (n * c * (1 - c)).sum() / n.sum()
        between = ((n * (s / n - c) ** 2).sum() / (len(n) - 1) - mean_var) / ((n.sum() - (n * n).sum() / n.sum()) / (len(n) - 1))
        return min(1e6, max(1.0, mean_var / between - 1)) if between > 0 else 1e6
    k = strength([(len(x), x.sum()) for x in by_host.values()], [prior] * 4)
    rate = {h: (x.sum() + k * prior) / (len(x) + k) for h, x in by_host.items()}
    paths = {}
    for h, a, x in rows:
        paths.setdefault((h, a), []).append(x)
    k2 = strength([(len(x), sum(x)) for x in paths.values()], [rate[h] for h, _ in paths])
    for key, x in paths.items():
        assert got[key]["prior"] == pytest.approx(prior)
        assert got[key]["host_rate"] == pytest.approx(rate[key[0]])
        assert got[key]["rate"] == pytest.approx((sum(x) + k2 * rate[key[0]]) / (len(x) + k2))
    assert 0 < rate["one"] < prior and abs(rate["big"] - 0.9) < 0.02


def test_odd_rows_and_missing_labels(spark):
    docs = spark.createDataFrame([(1, "Good text here.", "a", "en", "h"), (1, "Good text here.", "a", "en", "h"),
                                  (2, None, None, None, "h"), (3, "", "a", "en", "h"), (None, "x !! YY", "b", None, "h")],
                                 "doc_id long, text string, source string, lang string, host string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = q.classify(docs, none, *section(docs))
    rows = out.collect()
    assert len(rows) == 5 and all(r["keep"] and r["evidence"] == 0.5 for r in rows)
    assert sorted(out.select("row.*").columns) == sorted(docs.columns)
    one_class = spark.createDataFrame([(1, 0), (2, None), (3, 7)], "doc_id long, quality int")
    assert q.classify(docs, one_class, *section(docs)).where("keep").count() == 5
    assert q.classify(docs.limit(0), none, *section(docs)).count() == 0


def test_sites_beyond_the_broadcast_bound(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 100")
    labels = spark.read.parquet(f"{SF}/labels.parquet")

    def decisions():
        return {r["doc_id"]: r["keep"] for r in q.classify(docs, labels, *section(docs)).select(
            "row.doc_id", "keep").collect()}
    first = decisions()
    monkeypatch.setattr(q, "SITE_BROADCAST_ROWS", 0)
    assert decisions() == first and len(first) == docs.select(F.count("*")).first()[0]
