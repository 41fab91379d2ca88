"""The pipeline: each stage against a brute-force version of itself."""

import numpy as np
import pytest
from test_simhash import plain
from test_suffix_dedup import brute

import corpus_pipeline
from churnwise.llm import mixing, packing, simhash
from churnwise.llm.common import written
from churnwise.llm.queries import TARGET_WEIGHTS, tokenizer
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def staged(spark):
    docs, out = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF_SMALL))
        out.append((name, docs))
    return dict(out)


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark, staged):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "mixing", "packing"]
    for name in ("quality", "near_duplicates", "repeats", "mixing"):
        assert staged[name].dtypes == docs.dtypes


def test_quality(spark, staged):
    before, after = rows(spark.read.parquet(f"{SF_SMALL}/documents.parquet")), rows(staged["quality"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    assert all((d in after) == (labels[d] == 1) for d in before if d in labels)
    assert all(after[d] == before[d] for d in after)


def test_near_duplicates(staged):
    before, after = rows(staged["quality"]), rows(staged["near_duplicates"])
    ids = sorted(before)
    prints = {d: plain(before[d]["text"]) for d in ids}
    root = {d: d for d in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and root[a] < root[b]:
                    root[b], changed = root[a], True
    assert sorted(after) == sorted(set(root.values()))
    assert all(after[d] == before[d] for d in after)


def test_repeats(staged):
    before, after = rows(staged["near_duplicates"]), rows(staged["repeats"])
    want = {d: kept.decode("utf-8", "ignore") for d, _, _, _, kept in brute([(d, r["text"]) for d, r in before.items()])}
    assert {d: r["text"] for d, r in after.items()} == want
    assert all(r["n_chars"] == len(r["text"]) and r["source"] == before[d]["source"] for d, r in after.items())


def test_mixing(staged):
    assert rows(staged["mixing"]) == rows(staged["repeats"])
    source = [s if s in TARGET_WEIGHTS else "rest" for s in
              (r["source"] for r in staged["mixing"].coalesce(1).collect())]
    share = mixing.slots_per_period({k: v for k, v in TARGET_WEIGHTS.items() if k in source})
    slots = [s for s, *_ in mixing.pfair_schedule(share)]
    assert source[:mixing.BLOCK_ROWS] == [slots[0]] * min(mixing.BLOCK_ROWS, source.count(slots[0]))


def test_packing(staged):
    words = packing.WordTokenizer(*tokenizer())
    got = {}
    for r in staged["packing"].collect():
        got.setdefault(r["doc_id"], []).append(r)
    want = {d: len(words.ids(r["text"] or "")) // 4 + 1 for d, r in rows(staged["mixing"]).items()}
    assert {d: sum(r["length"] for r in p) for d, p in got.items()} == want
    assert all(np.log2(r["length"]) % 1 == 0 for p in got.values() for r in p)


def test_run_is_the_stages(spark, staged):
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF_SMALL).select(key).collect())) == sorted(
        map(tuple, staged["packing"].select(key).collect()))


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_SMALL)
        assert docs.count() == 0


def test_odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids."""
    long = " ".join("word%d" % (i * 7919 % 5003) for i in range(150000))
    data = [(None, None, None, None, None), (None, "No id but words here.", "en", "src0", 21), (5, "", "en", "src0", 0),
            (5, "", "en", "src0", 0), (6, None, "fr", "src1", None), (7, long, "en", None, len(long)),
            (8, "x " + long, None, "src2", len(long) + 2), (9, "Plain words in a row, once more.", "en", "src0", 32),
            (9, "Other words under the same id.", "de", "src0", 30), (-3, "Plain words in a row, once more.", "en", "src0", 32)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF_SMALL))
        kept[name] = docs
    assert kept["quality"].count() == len(data)
    ids = sorted(str(r["doc_id"]) for r in kept["near_duplicates"].collect())
    # 5 and 6 have no words, 8 is 7 with one more word, 9 repeats -3 in one of its two rows
    assert ids.count("None") == 2 and {"-3", "5", "7"} <= set(ids) and "6" not in ids and "8" not in ids
    assert len(ids) == len(set(ids)) + 1
    assert kept["repeats"].count() == kept["mixing"].count() == len(ids)
    assert {str(r["doc_id"]) for r in kept["packing"].collect()} == set(ids)


def mixed_documents(spark):
    names = ["src0"] * 9 + ["src%d" % i for i in range(1, 8)]
    data = [(i, "w" * (i % 7 + 1), "en", names[i % len(names)], i % 7 + 1) for i in range(6000)]
    return names, spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")


def in_files(spark, df, rows=700):
    """``df`` written in files of at most ``rows`` rows and read again."""
    spark.conf.set("spark.sql.files.maxRecordsPerFile", rows)
    try:
        return written(df)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def order_of(packed):
    first = {}
    for r in packed.orderBy("sequence_id").collect():
        first.setdefault(r["doc_id"], len(first))
    return list(first)


def test_packing_keeps_the_order_of_the_mix(spark):
    """Sequences are numbered in the order of the mix, however the files with the rows are read."""
    names, docs = mixed_documents(spark)
    stored = in_files(spark, corpus_pipeline.mixing_stage(spark, docs, SF_SMALL))
    assert len(stored.inputFiles()) > 5
    first = order_of(written(corpus_pipeline.packing_stage(spark, stored, SF_SMALL).repartition(3)))
    mixed = mixing.mix(docs, TARGET_WEIGHTS).orderBy("place").collect()
    assert first == [r["doc_id"] for r in mixed]
    counts = {s: sum(r["source"] == s for r in mixed) for s in set(names)}
    share = mixing.slots_per_period(mixing.own_weights(TARGET_WEIGHTS, counts))
    total, target = sum(share.values()), [r["source"] for r in mixed if r["on_target"]]
    for n in range(mixing.BLOCK_ROWS, len(target) * 9 // 10, mixing.BLOCK_ROWS):  # whole blocks only
        got = [names[d % len(names)] for d in first[:n]]
        assert all(abs(got.count(s) - n * share[s] / total) < mixing.BLOCK_ROWS for s in share)


def test_without_mixing_the_order_is_another(spark):
    _, docs = mixed_documents(spark)
    stored = in_files(spark, docs.coalesce(1))
    assert order_of(corpus_pipeline.packing_stage(spark, stored, SF_SMALL)) == list(range(6000))


def test_extra_columns_survive(spark):
    names = ["kept", "place", "block", "n_bytes", "n_removed", "n_spans", "mix_source", "release", "deadline", "slot",
             "on_target", "target", "row", "key", "keep", "fp", "component", "src", "a b"]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(60)
    docs = written(docs.select("*", *[corpus_pipeline.F.concat(corpus_pipeline.F.lit(n), "doc_id").alias(n) for n in names]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, docs, SF_SMALL))
        assert after.dtypes == docs.dtypes, name
        assert after.count() > 0
        for r in after.collect():
            assert all(r[n] == f"{n}{r['doc_id']}" for n in names), name
        docs = after


def test_a_unique_text_under_a_repeated_id_stays(spark):
    a, b = "one two three four five six seven eight nine ten", "quite another text of words that nobody else has here"
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (3, b), (None, a)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in simhash.keep_one(docs).collect()) == sorted([(0, a), (1, a), (2, b)])
