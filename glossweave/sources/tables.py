"""Table reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave import schemas


def read_link_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Share links from CSV files with a header row; columns are taken by place.

    `link_id` follows from the row's content, so it is the same on every run.
    """
    rows = spark.read.schema(schemas.SHARE_LINKS).option("header", "true").option(
        "enforceSchema", "true"
    ).csv(path)
    return rows.select(
        F.xxhash64("filename", "share_url", "extract_code").alias("link_id"),
        "filename", "share_url", "extract_code",
    ).dropDuplicates(["link_id"])
