"""Resumable ingest of repertoire files and running cleaning totals with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.cleaning import adaptive_steps, clean_adaptive


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, clean: Callable[[DataFrame], DataFrame] = clean_adaptive, fmt: str = "parquet", files_per_batch: int = 100) -> StreamingQuery:
    """Clean files as they arrive and append them; files of earlier runs are skipped by the checkpoint.

    Each batch is written to a folder of its own number, so a batch that is repeated after a failure replaces itself.
    """
    rows = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(source)

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return clean(rows).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_funnel(rows: DataFrame) -> DataFrame:
    """Rows seen and kept by repertoire over a stream (output mode complete or update; no watermark is needed)."""
    steps = adaptive_steps(rows)
    return steps.groupBy("repertoire_id").agg(F.count("*").alias("n_input"), F.count_if(F.col("removed_by").isNull()).alias("n_kept"))
