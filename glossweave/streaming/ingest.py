"""Incremental container ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glossweave import schemas
from glossweave.functions.names import base_name, title_from_filename, trim_stem
from glossweave.operators.catalog import register
from glossweave.sources.containers import members, metadata, valid_containers
from glossweave.sources.sinks import read_table

BOOK_ROWS = "book_id string, filename string, title string, author string, status string"


def container_stream(
    spark: SparkSession, folder: str, archive: str | None = None, files_per_batch: int = 1000
) -> DataFrame:
    """New container files; processed ones move to `archive` when it is given."""
    reader = (
        spark.readStream.format("binaryFile")
        .schema(schemas.CONTAINERS)
        .option("pathGlobFilter", "*.[eE][pP][uU][bB]")
        .option("maxFilesPerTrigger", files_per_batch)
    )
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(folder)


def ingest(
    files: DataFrame, books_path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Register every valid new container once, in the book table at `books_path`.

    Each micro-batch is written under its own batch number, so a batch that is run again
    after a lost driver replaces its own rows.
    """

    def register_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        listed = members(batch)
        valid = valid_containers(batch, listed).where("is_valid").select(
            "path", trim_stem(base_name(F.col("path"))).alias("filename")
        )
        scanned = valid.join(metadata(listed).drop("filename"), "path", "left").select(
            "filename",
            F.coalesce("title", title_from_filename(F.col("filename"))).alias("title"),
            "author",
        )
        known = _known_books(spark, books_path, batch_id)
        fresh = register(scanned, known).where("is_new").select(
            F.col("book_key").alias("book_id"), "filename", "title", "author", "status"
        )
        fresh.write.mode("overwrite").parquet(f"{books_path}/batch={batch_id}")

    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        register_batch
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _known_books(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        table = read_table(spark, path, BOOK_ROWS + ", batch long")
        return table.where(F.col("batch") < batch_id).drop("batch")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], BOOK_ROWS)
