"""Sinks: listing texts, report JSON, run counts, edition and archive paths, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.functions import patterns as P
from glossweave.functions.names import extension, short_name, stem
from glossweave.functions.text import strip


def listing_texts(texts: DataFrame) -> DataFrame:
    """`(book_id, listing, note)` to `(book_id, kind, text)`; an empty note gives no row."""
    return (
        texts.select(
            "book_id",
            F.explode(
                F.array(
                    F.struct(F.lit("listing").alias("kind"), F.col("listing").alias("text")),
                    F.struct(F.lit("note").alias("kind"), F.col("note").alias("text")),
                )
            ).alias("t"),
        )
        .select("book_id", "t.*")
        .where((F.col("kind") == "listing") | (F.length("text") > 0))
    )


def write_listing_texts(texts: DataFrame, folder: str) -> None:
    """One text file per book and kind, in `book_id=…/kind=…`.

    `lineSep` keeps a text in one piece; rows of a book are spread by book and kind, so no
    task holds more than its share.
    """
    (
        listing_texts(texts)
        .withColumn("text", F.coalesce("text", F.lit("")))
        .repartition("book_id", "kind")
        .write.mode("overwrite")
        .partitionBy("book_id", "kind")
        .text(folder)
    )


def read_listing_texts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.text(folder, wholetext=True).withColumnRenamed("value", "text")


def run_stats_json(stats: DataFrame, folder: str) -> None:
    stats.write.mode("overwrite").json(folder)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", by: list[str] | None = None) -> None:
    """Parquet is the store; `by` lays the files out for partition pruning."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Columns that older files lack come as null when a schema is given."""
    reader = spark.read.schema(schema) if schema else spark.read.option("mergeSchema", "true")
    return reader.parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def read_jdbc(
    spark: SparkSession, url: str, table: str, column: str, low: str, high: str, parts: int,
    **options: str,
) -> DataFrame:
    """Parallel read, split by a numeric or time column."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url, dbtable=table, partitionColumn=column, lowerBound=low, upperBound=high,
            numPartitions=str(parts), **options,
        )
        .load()
    )


def edition_paths(books: DataFrame, root: str) -> DataFrame:
    """One row per book and edition with folder and file paths."""
    base = strip(stem(F.col("filename")))
    short = short_name(F.col("filename"))
    editions = F.explode(F.array(*[F.lit(e) for e in P.EDITIONS])).alias("edition")
    named = books.select("book_id", base.alias("base"), short.alias("short"), editions)
    name = F.concat_ws("-", "edition", "short")
    folder = F.concat_ws("/", F.lit(root), "base", name)
    return named.select(
        "book_id",
        "edition",
        folder.alias("folder"),
        F.concat(folder, F.lit("/"), name, F.lit(".epub")).alias("epub_path"),
        F.concat(folder, F.lit("/"), name, F.lit(".pdf")).alias("pdf_path"),
    )


def archive_plan(files: DataFrame, archived: DataFrame, stamp: Column) -> DataFrame:
    """Target name of each container; names already archived get a time stamp."""
    names = archived.select(F.col("filename").alias("filename")).distinct()
    taken = names.withColumn("taken", F.lit(True))
    new = F.concat(stem(F.col("filename")), F.lit("_"), stamp, extension(F.col("filename")))
    return (
        files.where(F.col("filename").endswith(".epub"))
        .join(taken, "filename", "left")
        .select(
            "filename",
            F.coalesce("taken", F.lit(False)).alias("conflict"),
            F.when(F.col("taken"), new).otherwise(F.col("filename")).alias("target"),
        )
    )
