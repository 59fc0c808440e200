"""Arriving files as a stream: chunked and appended, each batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import non_blank
from ..operators.chunking import chosen_strategy, chunk_table


def ingest_text(spark: SparkSession, source: str, target: str, checkpoint: str, *, provider: str = "mock", embed: Callable[[DataFrame], DataFrame] | None = None):
    """Chunks the text files that have come to `source` since the last call, and appends
    them to the Parquet table `target`, by ingestion. Blank files are failed ingestions:
    they are written to `target`_failed. Returns the finished query.

    A batch overwrites the folders of its own number only, so a batch that is run again
    after a lost driver leaves its rows once."""
    files = spark.readStream.format("text").option("wholetext", "true").load(source)
    files = files.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))

    def save(batch: DataFrame, number: int) -> None:
        ok = non_blank(F.col("text"))
        rows = batch.withColumn("ingestion_id", F.sha1("path"))
        chunks = chunk_table(rows.where(ok).withColumn("chunk_strategy", chosen_strategy(F.col("text"))), key="ingestion_id")
        chunks = chunks.withColumn("provider", F.lit(provider))
        chunks = embed(chunks) if embed else chunks
        chunks.write.mode("overwrite").parquet(f"{target}/batch={number}")
        rows.where(~ok).select("ingestion_id", "path", F.lit("failed").alias("status")).write.mode("overwrite").parquet(f"{target}_failed/batch={number}")

    stream = files.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    return stream
