"""Hierarchical language identification: the family first, then one-versus-one linear
support vector machines between the languages of that family."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnwise.llm.common import each_text

# Language families by language code. A code that is not listed is a family of its own.
FAMILIES = {
    "af": "germanic", "da": "germanic", "de": "germanic", "en": "germanic", "is": "germanic", "nb": "germanic",
    "nl": "germanic", "no": "germanic", "sv": "germanic",
    "ca": "romance", "es": "romance", "fr": "romance", "gl": "romance", "it": "romance", "pt": "romance",
    "ro": "romance",
    "be": "slavic", "bg": "slavic", "cs": "slavic", "hr": "slavic", "pl": "slavic", "ru": "slavic", "sk": "slavic",
    "sl": "slavic", "sr": "slavic", "uk": "slavic",
    "et": "uralic", "fi": "uralic", "hu": "uralic",
}
UNDETERMINED = "und"
DIMENSIONS = 2048
SAMPLE_PER_LANGUAGE = 1000  # expected number of training texts of one language at most
TEXT_STEP = 1 << 20  # bytes of one text that are counted at a time

_FOLD = np.full(256, 32, np.uint32)  # letters in lower case, bytes of other scripts as they are, the rest a space
for _c in range(256):
    if _c >= 128 or chr(_c).isalpha():
        _FOLD[_c] = ord(chr(_c).lower()) if _c < 128 else _c


def profile(text: bytes) -> np.ndarray:
    """Hashed counts of the byte pairs and triples of a whole text, at unit length."""
    counts = np.zeros(DIMENSIONS, np.float64)
    for at in range(0, max(1, len(text)), TEXT_STEP):
        raw = np.frombuffer(text, np.uint8, count=min(TEXT_STEP + 2, len(text) - at), offset=at) if text else None
        if raw is None:
            break
        a = _FOLD[raw]
        last = at + TEXT_STEP >= len(text)
        if last:
            a = np.concatenate((a, np.array([32, 32], np.uint32)))
        pair = a[:-1] * np.uint32(0x9E3779B1) ^ a[1:] * np.uint32(0x85EBCA77)
        triple = pair[:-1] * np.uint32(0xC2B2AE3D) ^ a[2:] * np.uint32(0x27D4EB2F)
        for grams in (pair[:len(triple)], triple):
            grams = (grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            counts += np.bincount(grams >> np.uint32(21), minlength=DIMENSIONS)
    size = np.sqrt((counts * counts).sum())
    return counts / size if size else counts


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _profiles(text: pa.Array) -> pa.Array:
    return pa.array([profile(t) for t in each_text(text)], pa.list_(pa.float64()))


@dataclass(frozen=True)
class LanguageModel:
    """Pairwise linear machines between families and between the languages of a family.

    ``machines[(a, b)]`` holds weights and intercept; a positive margin means ``b``.
    """

    families: dict[str, list[str]]
    machines: dict[tuple[str, str], tuple[np.ndarray, float]]

    def _winner(self, names: list[str], x: np.ndarray, prefix: str) -> tuple[str, float]:
        votes, margins = dict.fromkeys(names, 0), {}
        for a, b in combinations(names, 2):
            w, c = self.machines[(prefix + a, prefix + b)]
            m = float(w @ x + c)
            margins[(a, b)], margins[(b, a)] = -m, m
            votes[b if m > 0 else a] += 1
        best = max(names, key=lambda n: (votes[n], sum(margins[(n, o)] for o in names if o != n)))
        sure = min((1 / (1 + np.exp(-2 * margins[(best, o)])) for o in names if o != best), default=1.0)
        return best, float(sure)

    def predict(self, text: bytes) -> tuple[str, float]:
        x = profile(text)
        family, sure = self._winner(sorted(self.families), x, "family:")
        language, sure2 = self._winner(self.families[family], x, "")
        return language, sure * sure2


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id",
        per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Learn from a bounded sample: of each language the texts whose key hashes below
    ``per_language`` divided by the language's number of rows.  Rows without text,
    language or letters are not used."""
    from pyspark.ml.classification import LinearSVC  # here, so that tasks need not import it
    from pyspark.ml.functions import array_to_vector

    rows = labelled.where(F.col(lang_col).isNotNull() & has_letter(F.col(text_col)))
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    languages = sorted(counts)
    share = F.create_map(*[F.lit(v) for k in languages for v in (k, min(1.0, per_language / counts[k]))]) \
        if languages else None
    families: dict[str, list[str]] = {}
    for name in languages:
        families.setdefault(FAMILIES.get(name, name), []).append(name)
    if not languages:
        return LanguageModel({}, {})
    draw = F.pmod(F.xxhash64(F.lit("sample"), key_col), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(draw < share[F.col(lang_col)]).select(
        F.col(lang_col).alias("lang"), array_to_vector(_profiles(F.col(text_col))).alias("features")).persist()
    family = F.create_map(*[F.lit(v) for k in languages for v in (k, FAMILIES.get(k, k))])[F.col("lang")]
    svm = LinearSVC(maxIter=25, regParam=0.003, standardization=False)
    machines = {}

    def learn(data: DataFrame, name, a: str, b: str, prefix: str) -> None:
        two = data.where(name.isin(a, b)).select("features", (name == b).cast("double").alias("label"))
        m = svm.fit(two)
        machines[(prefix + a, prefix + b)] = (np.array(m.coefficients), float(m.intercept))

    for a, b in combinations(sorted(families), 2):
        learn(sample, family, a, b, "family:")
    for members in families.values():
        for a, b in combinations(members, 2):
            learn(sample, F.col("lang"), a, b, "")
    sample.unpersist()
    return LanguageModel(families, machines)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1), predicted from the whole text alone.

    A text that is null or has no letter is ``und`` with score 0, as is every text when
    the model has no language.  Columns of those names are replaced; nothing is shuffled.
    """
    languages = sum(model.families.values(), [])

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predicted(text: pa.Array) -> pa.Array:
        found = [model.predict(t) for t in each_text(text)]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()),
                                           pa.array([f[1] for f in found], pa.float64())], ["lang_pred", "score"])

    out = docs.drop("lang_pred", "score")
    if not languages:
        return out.select("*", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    text = F.col(text_col)
    guess = F.when(has_letter(text), predicted(text))
    known = out.select("*", guess.alias("guess of this row"))
    return known.select(*[F.col(f"`{c}`") for c in out.columns],
                        F.coalesce(F.col("`guess of this row`.lang_pred"), F.lit(UNDETERMINED)).alias("lang_pred"),
                        F.coalesce(F.col("`guess of this row`.score"), F.lit(0.0)).alias("score"))
