"""The registered queries of this package: each applies its operator, with production
parameters, to the whole table and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnwise.llm import (best_fit, cross_polytope, embedding_dedup, language_id, license_scan, mixing, packing,
                           phrases, quality, sharding, simhash, spelling, suffix_dedup)
from churnwise.sources.bindings import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TARGET_WEIGHTS = {mixing.REST: 1.0}  # every source that occurs, by its tempered count


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def section(docs: DataFrame):
    """Host and path of a document: its source, and the source's section of one language."""
    return docs["source"], F.concat(F.lit("/"), F.coalesce(docs["lang"], F.lit("")))


@register
def op1_language_id(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = language_id.fit(docs.where(rest != 0))
    return language_id.identify(docs.select("doc_id", "text", F.coalesce(rest == 0, F.lit(False)).alias("held_out")),
                                model).drop("text")


@register
def op2_license_scan(spark, d):
    return license_scan.scan(table(spark, d, "documents"), license_scan.known_licenses(spark))


SQL["op2_license_scan"] = license_scan.scan_sql()


@register
def op3_quality(spark, d):
    docs = table(spark, d, "documents")
    out = quality.classify(docs, table(spark, d, "labels"), *section(docs))
    return out.select("row.doc_id", "host", "path", "evidence", "host_rate", "path_rate", "posterior", "keep")


def tokenizer() -> tuple[str, str]:
    """The public vocabulary file and its word pattern."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


@register
def op4_packing(spark, d):
    packed = packing.pack(table(spark, d, "documents"), *tokenizer(), added=True)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "bucket")


@register
def op5_sharding(spark, d):
    placed = sharding.shard(table(spark, d, "documents"), 24)
    return placed.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@register
def op8_simhash(spark, d):
    near = simhash.near_duplicates(table(spark, d, "documents"))
    return near.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                       F.col("component").alias("component_id"))


@register
def op9_mixing(spark, d):
    mixed = mixing.mix(table(spark, d, "documents"), TARGET_WEIGHTS)
    return mixed.select("doc_id", "source", "mix_source", "target", "block", "release", "deadline", "slot", "place", "on_target")


@register
def op7_embedding_dedup(spark, d):
    linked = embedding_dedup.link(table(spark, d, "embeddings"))
    return linked.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
                         F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


SQL["op7_embedding_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v
       WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0
         AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b
          ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
          WHERE list_dot_product(a.e, b.e) / a.norm / b.norm >= 0.98),
reach AS (SELECT vec_id AS n, vec_id AS r FROM v UNION SELECT links.x, reach.r FROM reach JOIN links ON reach.n = links.y),
low AS (SELECT n, min(r) AS component_id FROM reach GROUP BY n),
many AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN low ON low.n = v.vec_id LEFT JOIN many ON many.x = v.vec_id"""


@register
def op10_nearest(spark, d):
    rows = table(spark, d, "embeddings")
    return cross_polytope.nearest(rows, rows.where(F.col("vec_id") % 100 == 0))


@register
def op6_suffix_dedup(spark, d):
    cut = suffix_dedup.remove_repeats(table(spark, d, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL["op6_suffix_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, CAST(2 * p + 1 AS BIGINT), 100) AS s
      FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM d WHERE n >= 50)),
m AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s),
g AS (SELECT w.doc_id, w.p FROM w JOIN m ON w.s = m.s WHERE m.low < w.doc_id),
b AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50, true) AS first FROM g),
i AS (SELECT doc_id, p, sum(CAST(first AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM b),
spans AS (SELECT doc_id, span, min(p) AS a, max(p) + 50 AS z FROM i GROUP BY doc_id, span),
gaps AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
r AS (SELECT gaps.doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS last,
        string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS kept
      FROM gaps JOIN d ON d.doc_id = gaps.doc_id GROUP BY gaps.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept || substr(h, CAST(2 * last + 1 AS BIGINT)), h))) AS kept_sha256
FROM d LEFT JOIN r ON r.doc_id = d.doc_id"""


@register
def op11_best_fit(spark, d):
    pieces = best_fit.cut(table(spark, d, "documents"), *tokenizer())
    digests = pieces.select("item", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return digests.join(best_fit.place(pieces), "item").drop("item")


@register
def op12_phrases(spark, d):
    return phrases.collocations(table(spark, d, "documents"))


SQL["op12_phrases"] = phrases.collocations_sql()


@register
def op13_spelling(spark, d):
    return spelling.spelling_variants(table(spark, d, "documents")).select(
        "word", "form", "root", "n", "n_near", "form_n")
