"""Document quality by hierarchical empirical Bayes: classifier evidence on top of host
and path posteriors that shrink to the global prior where a site has few documents."""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnwise.llm.common import each_text, written

LABEL_SAMPLE = 10_000  # expected number of labelled documents the classifier learns from at most
SITE_BROADCAST_ROWS = 100_000  # site rows (three numbers and two names) broadcast at most
TEXT_STEP = 1 << 20  # bytes of one text whose words are looked at together
LEAST, MOST = 1e-6, 1 - 1e-6  # probabilities are kept inside

_CLASS = np.zeros(256, np.intp)  # 0 other, 1 upper case, 2 lower case, 3 digit, 4 white space, 5 sentence marks, 6 symbols
for _c in range(128):
    _s = chr(_c)
    _CLASS[_c] = (1 if _s.isupper() else 2 if _s.islower() else 3 if _s.isdigit() else 4 if _s.isspace()
                  else 5 if _s in ".,;:'\"-()?" else 6)
FEATURES = ("upper", "digit", "marks", "symbols", "repeats", "word length", "lines", "size")


def features(text: bytes) -> list[float]:
    """Shares and lengths of a whole text: upper case among its letters, digits, marks and
    symbols among its characters, words that repeat the word before, mean word length, lines
    per word, logarithm of the size."""
    kinds, words, chars, repeats, last = np.zeros(7, np.int64), 0, 0, 0, None
    at = 0
    while at < len(text):
        end = at + TEXT_STEP
        gap = text.find(b" ", end) if end < len(text) else -1
        end = gap if gap >= 0 else len(text)
        part = text[at:end]
        kinds += np.bincount(_CLASS[np.frombuffer(part, np.uint8)], minlength=7)
        found = part.split()
        if found:
            repeats += sum(map(eq, found, found[1:])) + (found[0] == last)
            words, chars, last = words + len(found), chars + sum(map(len, found)), found[-1]
        at = end
    n = max(1, len(text))
    letters = max(1, int(kinds[1] + kinds[2]))
    return [kinds[1] / letters, kinds[3] / n, kinds[5] / n, kinds[6] / n, repeats / max(1, words),
            min(chars / max(1, words), 50.0) / 10, text.count(b"\n") / max(1, words), float(np.log1p(len(text))) / 10]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _features(text: pa.Array) -> pa.Array:
    return pa.array([features(t) for t in each_text(text)], pa.list_(pa.float64()))


@dataclass(frozen=True)
class QualityModel:
    """Logistic evidence: weights over ``FEATURES`` and an intercept."""

    weights: list[float]
    intercept: float


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", sample: int = LABEL_SAMPLE) -> QualityModel:
    """Learn the document classifier from at most about ``sample`` labelled documents.

    The sample is drawn from the labels by hash, so the table that is joined to the texts
    has a bound and is broadcast.  Labels other than 0 and 1 are not used; without both
    classes there is no evidence and every document counts as good as another.
    """
    from pyspark.ml.classification import LogisticRegression  # here, so that tasks need not import it
    from pyspark.ml.functions import array_to_vector

    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("labelled"), F.col(label_col).cast("double").alias("label")).distinct()
    total = usable.count()
    draw = F.pmod(F.xxhash64(F.lit("sample"), "labelled"), F.lit(1 << 20)) / float(1 << 20)
    chosen = usable.where(draw < min(1.0, sample / max(1, total)))
    rows = (docs.select(F.col(id_col).alias("labelled"), F.col(text_col).alias("text"))
            .join(F.broadcast(chosen), "labelled")
            .select("label", array_to_vector(_features(F.col("text"))).alias("features"))).persist()
    if rows.select("label").distinct().count() < 2:
        rows.unpersist()
        return QualityModel([0.0] * len(FEATURES), 0.0)
    model = LogisticRegression(maxIter=50, regParam=1e-4).fit(rows)
    rows.unpersist()
    return QualityModel([float(w) for w in model.coefficients], float(model.intercept))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(LEAST)), F.lit(MOST))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, prior: Column) -> float:
    """Pseudo-documents of a Beta prior by the method of moments over (n, s) groups: large
    where the groups hardly differ by more than chance, small where they do."""
    rate = F.col("s") / F.col("n")
    spread = F.sum(F.col("n") * (rate - prior) * (rate - prior))
    r = groups.agg(spread.alias("v"), F.sum(F.col("n") * prior * (1 - prior)).alias("b"),
                   F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"),
                   F.sum(F.col("n") * F.col("n")).alias("n2")).first()
    if not r["n"] or r["k"] < 2 or not r["b"]:
        return 1.0
    mean_var = r["b"] / r["n"]
    size = (r["n"] - r["n2"] / r["n"]) / (r["k"] - 1)
    between = (r["v"] / (r["k"] - 1) - mean_var) / max(size, 1e-9)
    return float(min(1e6, max(1.0, mean_var / between - 1))) if between > 0 else 1e6


def site_rates(paths: DataFrame) -> DataFrame:
    """(host, path, n, host_rate, rate, prior) from the sums (host, path, n, s) of evidence.

    The global prior is the mean evidence; a host's rate is its mean drawn to the prior
    with the weight of the hosts' common Beta prior, and a path's rate is its mean drawn
    to its host's rate.
    """
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    prior = total["s"] / total["n"] if total["n"] else 0.5
    k = _strength(hosts, F.lit(prior))
    hosts = hosts.select("host", ((F.col("s") + k * prior) / (F.col("n") + k)).alias("host_rate"))
    both = paths.join(hosts, "host")
    k2 = _strength(both, F.col("host_rate"))
    return both.select("host", "path", "n", "host_rate",
                       ((F.col("s") + k2 * F.col("host_rate")) / (F.col("n") + k2)).alias("rate"),
                       F.lit(prior).alias("prior"))


def site_sums(evidence: DataFrame) -> DataFrame:
    """(host, path, n, s): number of rows (host, path, p) and their total evidence.  Sums are
    combined map-side, so a host with most of the documents costs each task one row."""
    return evidence.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id",
             text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(row, host, path, evidence, host_rate, path_rate, posterior, keep) per row of ``docs``.

    ``row`` is a struct of the row's own columns, whatever their names.  The posterior
    log-odds are the classifier's plus what the path's rate adds to the global prior;
    ``keep`` is a posterior of at least ``least``.  Null hosts and paths count as the
    empty name, null texts as empty; repeated rows each count, an empty table stays empty.
    The texts are read twice and never shuffled: the site table is broadcast up to
    ``SITE_BROADCAST_ROWS`` rows and joined by its key beyond.
    """
    model = fit(docs, labels, id_col, text_col)
    weights = np.array(model.weights)

    @F.arrow_udf("double")
    def log_odds(text: pa.Array) -> pa.Array:
        x = np.array([features(t) for t in each_text(text)]).reshape(len(text), len(weights))
        return pa.array(x @ weights + model.intercept, pa.float64())

    name = F.coalesce(host.cast("string"), F.lit(""))
    part = F.coalesce(path.cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), name.alias("host"), part.alias("path"),
                       log_odds(F.col(text_col)).alias("z"))
    odds = 1 / (1 + F.exp(-F.col("z")))
    sums = written(site_sums(rows.select("host", "path", odds.alias("p"))))
    sites = site_rates(sums).drop("n")
    if sums.count() <= SITE_BROADCAST_ROWS:
        sites = F.broadcast(sites)
    posterior = 1 / (1 + F.exp(-(F.col("z") + _logit(F.col("rate")) - _logit(F.col("prior")))))
    return rows.join(sites, ["host", "path"]).select(
        "row", "host", "path", odds.alias("evidence"), "host_rate", F.col("rate").alias("path_rate"),
        posterior.alias("posterior"), (posterior >= least).alias("keep"))
