"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's ``docs``; all but the last return the columns of
``documents``.  No stage but the first reads another table (``labels``).

``ORACLE_SQL`` is None: the classifier, the fingerprints, the removal of shared bytes and
the tokenizer have no SQL form; ``tests/llm/test_pipeline.py`` holds each stage against a
brute-force version.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnwise.llm import mixing, packing, quality, simhash, suffix_dedup
from churnwise.llm.common import written
from churnwise.llm.queries import TARGET_WEIGHTS, section, tokenizer
from churnwise.sources.bindings import table

def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Every stage takes nulls in any column, empty and very long texts, ties, repeated rows, an empty table and
    extra columns of any name, which it hands on; what becomes of them is told by the operator it calls.
    """
    out = quality.classify(docs, table(spark, sf_dir, "labels"), *section(docs))
    return out.where("keep").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; rows without an id stay."""
    return simhash.keep_one(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, without the passages that a document with a smaller id has.

    ``n_chars`` is counted anew; the other columns are carried as one struct.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = suffix_dedup.remove_repeats(docs.select("doc_id", "text", F.struct(F.lit(0), *others).alias("row")), as_text=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    made = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)}
    return cut.select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; the rows are written in the order of the mix, which the next stage reads."""
    mixed = mixing.mix(docs, TARGET_WEIGHTS, as_struct=True).orderBy("place")
    return mixed.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def in_file_order(docs: DataFrame) -> DataFrame:
    """``docs`` in the order in which its rows were written: by the numbers in the names of Spark's files, then
    by row.  Spark reads files in any order; a table that comes from no file is taken as it is."""
    try:
        placed = docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return docs
    number = [F.regexp_extract("_file", p, 1).cast("long") for p in (r"^part-(\d+)", r"-c(\d+)\.")]
    return placed.orderBy(*[F.coalesce(n, F.lit(0)) for n in number], "_file", "_row").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per packed sequence, numbered in the order in which the documents were written."""
    packed = packing.pack(in_file_order(docs), *tokenizer(), added=True)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeats_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
