"""Translation-memory maintenance from a stream of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glossweave.functions.text import is_blank, source_hash

DELTA = "source_hash string, source_text string, translated_text string, batch long"


def first_entries(entries: DataFrame, ttl: str = "30 days") -> DataFrame:
    """The first entry per source text within `ttl`; state older than that is dropped.

    `entries` holds `(source_text, translated_text, ts)`; a zone-less time is cast, as
    watermarks need a timestamp.
    """
    timed = entries.withColumn("ts", F.col("ts").cast("timestamp")).withColumn(
        "source_hash", source_hash(F.col("source_text"))
    )
    return timed.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["source_hash"])


def upsert_stream(
    entries: DataFrame, deltas: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Last-wins memory: every micro-batch adds its own changes as `batch=<n>`.

    Only the changes are written, folded to one row per source text. A batch that is run
    again replaces its own files, so the result is the same.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        latest = (
            batch.where(~is_blank(F.col("translated_text")))
            .withColumn("source_hash", source_hash(F.col("source_text")))
            .groupBy("source_hash")
            .agg(
                F.max_by(
                    F.struct("source_text", "translated_text"), F.struct("ts", "translated_text")
                ).alias("e")
            )
            .select("source_hash", "e.*")
        )
        latest.write.mode("overwrite").parquet(f"{deltas}/batch={batch_id}")

    writer = entries.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current(spark: SparkSession, deltas: str) -> DataFrame:
    """The memory after all batches: the entry of the latest batch per source text."""
    rows = spark.read.schema(DELTA).parquet(deltas)
    return (
        rows.groupBy("source_hash")
        .agg(F.max_by(F.struct("source_text", "translated_text"), "batch").alias("e"))
        .select("source_hash", "e.*")
    )
