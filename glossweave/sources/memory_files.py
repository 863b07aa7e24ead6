"""Translation-memory files: `{"cache": {hash: {source, translated, timestamp}}}`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.functions import patterns as P

_FILE = "cache map<string, struct<source:string, translated:string, timestamp:double>>"


def read_memory_json(spark: SparkSession, path: str) -> DataFrame:
    """`(source_hash, source_text, translated_text, ts)`; one file is one JSON object."""
    files = spark.read.text(path, wholetext=True)
    return parse_memory_json(files, "value")


def parse_memory_json(files: DataFrame, column: str) -> DataFrame:
    parsed = files.select(F.from_json(F.col(column), _FILE).alias("j"))
    return parsed.select(F.explode("j.cache").alias("source_hash", "e")).select(
        "source_hash",
        F.col("e.source").alias("source_text"),
        F.col("e.translated").alias("translated_text"),
        F.coalesce("e.timestamp", F.lit(0.0)).alias("ts"),
    )


def not_expired(entries: DataFrame, as_of: float, ttl: int = P.MEMORY_TTL_SECONDS) -> DataFrame:
    """Entries at most `ttl` seconds old at `as_of` (epoch seconds)."""
    return entries.where(F.lit(float(as_of)) - F.col("ts") <= ttl)


def new_entries(imported: DataFrame, memory: DataFrame) -> DataFrame:
    """Imported entries with both texts whose hash the memory does not hold yet."""
    filled = imported.where(
        (F.coalesce(F.length("source_text"), F.lit(0)) > 0)
        & (F.coalesce(F.length("translated_text"), F.lit(0)) > 0)
    )
    one = filled.groupBy("source_hash").agg(
        F.min(F.struct("source_text", "translated_text")).alias("e")
    ).select("source_hash", "e.*")
    return one.join(memory.select("source_hash"), "source_hash", "left_anti")
