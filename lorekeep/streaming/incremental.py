"""Incremental upkeep as streams: embeddings for new chunks, and upserts of changed rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators import index, vectors
from lorekeep.sources.tables import exists


def embed_new(chunks: DataFrame, vectors_path: str, embed: Callable[[list[str]], list[list[float]]], checkpoint: str, **options):
    """A stream of chunks (chunk_id, embed_text) to a table of vectors; what has one already is passed over.

    The query's checkpoint and the anti-join make it resumable: a batch that ran half is run
    again and adds only what is missing.
    """
    spark = chunks.sparkSession

    def batch(df: DataFrame, _: int) -> None:
        todo = df.dropDuplicates(["chunk_id"])
        if exists(spark, vectors_path):
            todo = index.missing_vectors(todo, spark.read.parquet(vectors_path).select("chunk_id"))
        vectors.embedded(todo, embed, **options).write.mode("append").parquet(vectors_path)

    return chunks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events (ts, event_type, value) by time window and type, with late data up to a watermark."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return at.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")
