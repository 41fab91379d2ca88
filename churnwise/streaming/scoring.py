"""Continuous risk scoring of arriving customer rows.

Scoring is a stateless per-row transform, so the same ``score`` plan runs on a
streaming DataFrame: no watermark or state store is needed, every micro-batch
is scored independently, and the query restarts from its checkpoint after a
failure (the checkpoint lives in the shared checkpoint folder).
"""

from __future__ import annotations

import os

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from churnwise.operators.model import score
from churnwise.session import checkpoint_dir


def read_customer_stream(spark: SparkSession, directory: str, schema: StructType,
                         max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files appearing in ``directory`` as an unbounded table."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(directory)


def score_stream(model: PipelineModel, stream: DataFrame) -> DataFrame:
    """The batch scorer applied to a stream (same plan, same columns)."""
    return score(model, stream)


def start_scoring(model: PipelineModel, stream: DataFrame, sink_dir: str, name: str = "churn_scores",
                  checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Write scored rows as Parquet; ``available_now`` processes what has
    arrived and stops, otherwise the query keeps running."""
    spark = stream.sparkSession
    ckpt = checkpoint or os.path.join(checkpoint_dir(spark), f"stream-{name}")
    writer = (score_stream(model, stream).writeStream.format("parquet")
              .option("path", sink_dir).option("checkpointLocation", ckpt).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def latest_scores(scores: DataFrame, key: str = "customer_id", at: str = "updated_at") -> DataFrame:
    """Of the scored rows of each ``key`` the one with the newest ``at``, all columns.

    Arrivals may repeat, be corrected later or come late: the sink of ``start_scoring`` holds every arrival once
    (its log makes a restarted batch write nothing twice), and this reads one row per customer from it.  So no
    arrival is too late, no state is held however many customers there are, and the rows of a customer with many
    corrections are combined before the shuffle.  Null ``at`` is the oldest; of different rows with the same
    ``at`` one is chosen by content, the same in every run; rows without a key are left out.
    """
    names = scores.columns
    newest = F.max_by(F.struct(*names), F.struct(F.col(at).alias("at"), F.xxhash64(*names).alias("tie")))
    return scores.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        newest.alias("newest")).select("newest.*")
