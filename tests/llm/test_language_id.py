"""Language id: held-out accuracy, what decides, odd rows."""

import zlib

from pyspark.sql import functions as F

from churnwise.llm import language_id as li
from churnwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    out = QUERIES["op1_language_id"](spark, SF)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = out.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    held = [r["lang_pred"] == r["lang"] for r in rows if r["held_out"]]
    assert sum(held) / len(held) > 0.97


def test_families_and_odd_rows(spark):
    say = {"en": "the cat and the dog of this house ", "de": "der hund und die katze nicht ", "fr": "le chien et la maison des ",
           "es": "el perro y los gatos para una ", "zz": "qoq xox qox xoq "}
    data = [(i, text * (1 + i % 4), lang) for lang, text in say.items() for i in range(40)]
    df = spark.createDataFrame(data + [(99, None, "en"), (98, "text", None), (97, "123", "en")], "doc_id long, text string, lang string")
    model = li.fit(df)
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"], "zz": ["zz"]}
    ask = spark.createDataFrame([(1, v, k, "old") for k, v in say.items()] + [
        (2, None, "und", "old"), (3, "", "und", "old"), (4, "123 !?", "und", "old"), (5, "the dog " * 400000, "en", "old")],
        "doc_id long, text string, want string, score string")
    got = li.identify(ask, model)
    assert got.columns == ["doc_id", "text", "want", "lang_pred", "score"]
    rows = got.collect()
    assert [r["lang_pred"] for r in rows] == [r["want"] for r in rows]
    assert all(r["score"] == 0 for r in rows if r["lang_pred"] == "und")
    assert li.identify(ask.limit(0), model).count() == 0


def test_no_and_one_language(spark):
    none = li.fit(spark.createDataFrame([(1, None, "en")], "doc_id long, text string, lang string"))
    one = li.fit(spark.createDataFrame([(1, "some text", "en")], "doc_id long, text string, lang string"))
    ask = spark.createDataFrame([("any text",), (None,)], "text string")
    assert [r["lang_pred"] for r in li.identify(ask, none).collect()] == ["und", "und"]
    assert [(r["lang_pred"], r["score"]) for r in li.identify(ask, one).collect()] == [("en", 1.0), ("und", 0.0)]


def test_profile_in_steps(monkeypatch):
    text = ("Straße über " * 40).encode()
    whole = li.profile(text)
    monkeypatch.setattr(li, "TEXT_STEP", 64)
    assert abs(li.profile(text) - whole).max() < 0.02
    assert li.profile(b"").sum() == 0


def test_letters(spark):
    df = spark.createDataFrame([("é",), ("1",), (None,), ("中",)], "t string")
    assert [r[0] for r in df.select(li.has_letter(F.col("t"))).collect()] == [True, False, False, True]
