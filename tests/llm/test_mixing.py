"""Mixing: Pfair windows, deviation, whole results."""

from fractions import Fraction

import pytest

from churnwise.llm import mixing
from churnwise.llm.queries import TARGET_WEIGHTS


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 1e-9},
                                     {"s%d" % i: i + 1 for i in range(30)}])
def test_less_than_one_block_off(weights):
    share = mixing.slots_per_period(weights)
    total = sum(share.values())
    assert all(v >= 1 for v in share.values()) and total == mixing.PERIOD
    done = dict.fromkeys(share, 0)
    rows = mixing.pfair_schedule(share)
    assert [r[4] for r in rows] == list(range(total))
    for s, j, release, deadline, slot in rows:
        assert done[s] == j and release <= slot < deadline
        done[s] += 1
        assert all(abs(done[k] - (slot + 1) * share[k] / total) < 1 for k in share)
    assert done == share


def test_every_row_once_and_on_target(spark):
    data = [(i, "t%d" % i, "a" if i % 3 else "b" if i % 2 else None, "x") for i in range(4000)] + [(None, None, "b", "x")] * 3
    df = spark.createDataFrame(data, "doc_id long, text string, source string, slot string")
    out = mixing.mix(df, {"a": 0.5, "b": 0.3, "rest": 0.2, "absent": 0.4}, block_rows=4)
    rows = sorted(out.collect(), key=lambda r: r["place"])
    assert len(rows) == len(data) and len({r["place"] for r in rows}) == len(data)
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(d[0]) for d in data)
    assert out.columns[:3] == ["doc_id", "text", "source"] and out.columns.count("slot") == 1
    share = mixing.slots_per_period({"a": 0.5, "b": 0.3, "rest": 0.2})
    blocks, seen = {"a": set(), "b": set(), "rest": set()}, 0
    for r in rows:
        assert r["release"] <= r["slot"] < r["deadline"] and r["mix_source"] == (r["source"] or "rest")
        if r["on_target"]:
            blocks[r["mix_source"]].add(r["block"])
            seen = r["slot"] + 1
            done = {s: len(b) for s, b in blocks.items()}
            assert all(abs(done[s] - seen * share[s] / 1000) < 1 + 1e-9 for s in share)
    assert sum(r["on_target"] for r in rows) > 1000
    again = sorted(mixing.mix(df, {"a": 0.5, "b": 0.3, "rest": 0.2, "absent": 0.4}, block_rows=4).collect(),
                   key=lambda r: r["place"])
    assert [r["doc_id"] for r in again] == [r["doc_id"] for r in rows]


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "doc_id long, source string")
    assert mixing.mix(df, {"a": 1.0}).count() == 0
    one = spark.createDataFrame([(1, "z")], "doc_id long, source string")
    assert [r["place"] for r in mixing.mix(one, {"a": 1.0}).collect()] == [0]
    with pytest.raises(ValueError):
        mixing.mix(one, {"a": 0.0})


def test_every_source_has_its_own_blocks(spark):
    """Twenty sources, one with a third of the rows: each is less than one block from its own target."""
    names = ["hot"] * 9 + ["src%d" % i for i in range(19)]
    df = spark.createDataFrame([(i, names[i % len(names)]) for i in range(28 * 150)], "doc_id long, source string")
    rows = sorted(mixing.mix(df, TARGET_WEIGHTS, block_rows=4).collect(), key=lambda r: r["place"])
    assert len(rows) == df.count() and all(r["mix_source"] == r["source"] for r in rows)
    share = mixing.slots_per_period(mixing.own_weights(TARGET_WEIGHTS, {s: names.count(s) for s in names}))
    total, blocks = sum(share.values()), {s: set() for s in names}
    assert share["hot"] / total < 0.95 * 9 / 28 and min(share.values()) / total > 1.03 / 28
    for r in rows:
        assert r["release"] <= r["slot"] < r["deadline"]
        if r["on_target"]:
            blocks[r["source"]].add(r["block"])
            assert all(abs(len(b) - (r["slot"] + 1) * share[s] / total) < 1 + 1e-9 for s, b in blocks.items())
    assert sum(r["on_target"] for r in rows) > 0.75 * len(rows)


def test_named_sources_and_the_rest():
    counts = {"a": 10, "b": 1000, "c": 1000, "rest": 5}
    own = mixing.own_weights({"a": 0.4, "rest": 0.6, "absent": 1.0}, counts)
    assert own["a"] == 0.4 and own["b"] == own["c"] and sum(own.values()) == pytest.approx(1.0)
    assert set(mixing.own_weights({}, counts)) == set(counts)
    many = mixing.slots_per_period(mixing.own_weights({"rest": 1.0}, {str(i): 1 + 9 * (i % 2) for i in range(3000)}))
    assert many["1"] > many["0"]


def test_exact_weights_over_a_million_slots():
    """Twenty sources with a hot one: each is less than one block from its exact weight after any slot."""
    weights = {"s%02d" % i: w for i, w in enumerate([0.3371, *[round(0.0211 + 0.0013 * i, 4) for i in range(19)]])}
    n = 1_000_000
    target = mixing.target_weights(weights, dict.fromkeys(weights, 1))
    assert sum(target.values()) == 1
    assert all(target[s] == Fraction(str(w)) / sum(Fraction(str(x)) for x in weights.values()) for s, w in weights.items())
    rows = mixing.schedule_blocks(target, {s: int(w * n) for s, w in target.items()})
    done, worst = dict.fromkeys(weights, 0), 0.0
    exact = {s: (w.numerator, w.denominator) for s, w in target.items()}
    for at, (s, j, release, deadline, slot) in enumerate(rows):
        if slot != at:  # a source has run out
            break
        assert done[s] == j and release <= slot < deadline
        done[s] += 1
        a, b = exact[s]
        worst = max(worst, abs(done[s] * b - (slot + 1) * a) / b)
        if at % 997 == 0:
            assert all(abs(done[k] * d - (slot + 1) * c) < d for k, (c, d) in exact.items())
    assert at > 0.999 * n and worst < 1


def test_weights_as_written():
    assert mixing.target_weights({"a": 0.3, "b": 0.1, "rest": 0.6}, {"a": 5, "b": 5, "c": 5, "d": 5}) == {
        "a": Fraction(3, 10), "b": Fraction(1, 10), "c": Fraction(3, 10), "d": Fraction(3, 10)}
    assert mixing.target_weights({}, {}) == {}


def test_registered_query_shows_the_weights(spark):
    from churnwise.llm.queries import QUERIES
    from conftest import SF_SMALL
    rows = QUERIES["op9_mixing"](spark, SF_SMALL).collect()
    assert len(rows) == len({r["place"] for r in rows}) == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    target = {r["mix_source"]: r["target"] for r in rows}
    assert sum(target.values()) == pytest.approx(1)
    blocks = {s: set() for s in target}
    for r in sorted(rows, key=lambda r: r["place"]):
        assert r["release"] <= r["slot"] < r["deadline"]
        if r["on_target"]:
            blocks[r["mix_source"]].add(r["block"])
            assert all(abs(len(b) - (r["slot"] + 1) * target[s]) < 1 + 1e-9 for s, b in blocks.items())


def test_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 3)
    df = spark.createDataFrame([(i, "s%d" % i) for i in range(4)], "doc_id long, source string")
    with pytest.raises(ValueError, match="sources"):
        mixing.mix(df, {"rest": 1.0})
    assert mixing.mix(df.where("doc_id < 3"), {"rest": 1.0}).count() == 3
