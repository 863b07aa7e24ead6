"""The book table: lookups, registration plans, status, output upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.functions import patterns as P
from glossweave.functions.names import fix_stem
from glossweave.functions.text import is_blank


def newest_first(recency: str = "created_seq", key: str = "book_id") -> list[Column]:
    return [F.col(recency).desc(), F.col(key).asc()]


def lookup(books: DataFrame, column: str, value) -> DataFrame:
    """First book with the given id or file name."""
    return books.where(F.col(column) == F.lit(value)).orderBy("book_id").limit(1)


def by_status(books: DataFrame, status: str | None = None) -> DataFrame:
    """Books, newest first, of one status or all."""
    kept = books if status is None else books.where(F.col("status") == status)
    return kept.orderBy(*newest_first())


def resolve_prefix(books: DataFrame, prefix: str) -> DataFrame:
    """Newest book whose id or file name starts with `prefix`."""
    book_id = F.col("book_id").cast("string")
    return (
        books.where(book_id.startswith(prefix) | F.col("filename").startswith(prefix))
        .orderBy(*newest_first())
        .limit(1)
    )


def title_search(books: DataFrame, word: str) -> DataFrame:
    """Books with a summary whose title holds `word`; flags an ambiguous search.

    The count of matches is a scalar subquery, not a window over all rows.
    """
    found = books.where(
        (F.length(F.coalesce("summary_text", F.lit(""))) > 0)
        & F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lower(F.lit(word)))
    )
    total = found.agg((F.count(F.lit(1)) > 1).alias("is_ambiguous"))
    return found.withColumn("is_ambiguous", total.scalar())


def sku_prices(requests: DataFrame, skus: DataFrame) -> DataFrame:
    """Price of each requested item, 0 when it is not on the list, and what it includes.

    No side is named for a broadcast; the planner goes by the sizes it sees.
    """
    return requests.join(skus, "sku", "left").select(
        *requests.columns,
        F.coalesce("price", F.lit(0.0)).alias("price"),
        F.coalesce(F.array_join("includes", ", "), F.lit("")).alias("includes"),
    )


def sku_list(spark, skus: list[tuple[str, float, list[str]]]) -> DataFrame:
    return spark.createDataFrame(skus, "sku string, price double, includes array<string>")


def status_counts(books: DataFrame) -> DataFrame:
    """Dashboard counts in one pass."""
    status = F.col("status")
    return books.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "pending").alias("pending"),
        F.count_if(status.isin(P.BUSY_STATUSES)).alias("processing"),
        F.count_if(status == "completed").alias("completed"),
        F.count_if(status == "published").alias("published"),
        F.count_if(status == "failed").alias("failed"),
    )


def ingest_plan(scanned: DataFrame, books: DataFrame, outputs: DataFrame) -> DataFrame:
    """`new`, `retry` (known, no output yet) or `skip` per scanned file.

    `outputs` holds one row per produced file with its `book_id`.
    """
    known = books.groupBy("filename").agg(F.min("book_id").alias("book_id"))
    produced = outputs.select("book_id").distinct().withColumn("_has", F.lit(True))
    joined = scanned.join(known, "filename", "left").join(produced, "book_id", "left")
    return joined.select(
        "filename",
        "book_id",
        F.when(F.col("book_id").isNull(), "new")
        .when(F.col("_has"), "skip")
        .otherwise("retry")
        .alias("action"),
    )


def register(scanned: DataFrame, books: DataFrame) -> DataFrame:
    """Known books plus one new row per file name that is not known yet."""
    fresh = (
        scanned.groupBy("filename")
        .agg(F.min(F.struct("title", "author")).alias("m"))
        .join(books.select("filename"), "filename", "left_anti")
        .select(
            F.substring(F.sha2("filename", 256), 1, 32).alias("book_key"),
            "filename",
            F.coalesce("m.title", "filename").alias("title"),
            F.col("m.author").alias("author"),
            F.lit("pending").alias("status"),
            F.lit(True).alias("is_new"),
        )
    )
    known = books.select(
        F.col("book_id").cast("string").alias("book_key"), "filename", "title", "author",
        "status", F.lit(False).alias("is_new"),
    )
    return known.unionByName(fresh)


def rename_plan(files: DataFrame) -> DataFrame:
    """Repaired name per file and whether the rename is carried out.

    A target that exists already is skipped; of several files with one target the first
    by source name gets it. The winner per target is an aggregate, so a target shared by
    very many files is folded before the shuffle.
    """
    fixed = files.select("filename").distinct().withColumn("target", fix_stem(F.col("filename")))
    moving = fixed.where(F.col("target") != F.col("filename"))
    taken = files.select(F.col("filename").alias("target")).distinct()
    winners = (
        moving.join(taken, "target", "left_anti")
        .groupBy("target")
        .agg(F.min("filename").alias("filename"))
        .withColumn("_wins", F.lit(True))
    )
    return fixed.join(winners, ["target", "filename"], "left").select(
        "filename",
        "target",
        F.when(F.col("target") == F.col("filename"), "keep")
        .when(F.col("_wins"), "rename")
        .otherwise("skip")
        .alias("action"),
    )


def fold_status(events: DataFrame) -> DataFrame:
    """Current status per book; an event without error text keeps the earlier error.

    `events` holds `(book_id, seq, status, error_message)`.
    """
    told = F.length(F.coalesce("error_message", F.lit(""))) > 0
    return events.groupBy("book_id").agg(
        F.max_by("status", "seq").alias("status"),
        F.max_by("error_message", F.when(told, F.col("seq"))).alias("error_message"),
    )


def upsert_outputs(outputs: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """Apply column changes `(book_id, seq, column, value)`; the last change per column
    wins, also when it sets null. Unknown columns are left out, missing rows created."""
    # A book whose changes are all unknown still gets its row.
    touched = changes.groupBy("book_id").agg(
        *[
            F.max_by(F.struct("value"), F.when(F.col("column") == c, F.col("seq"))).alias(f"_{c}")
            for c in columns
        ]
    )
    return outputs.join(touched, "book_id", "full").select(
        "book_id",
        *[
            F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.value"))
            .otherwise(F.col(c))
            .alias(c)
            for c in columns
        ],
    )


def delete_books(tables: dict[str, DataFrame], book_ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the given books."""
    return {name: df.join(book_ids, "book_id", "left_anti") for name, df in tables.items()}


def publish_ready(books: DataFrame, listings: DataFrame) -> DataFrame:
    """Whether each book has a listing text that is not blank."""
    text = listings.select("book_id", F.col("text").alias("_text"))
    return books.join(text, "book_id", "left").select(
        "book_id",
        F.when(F.col("_text").isNull(), "no listing")
        .when(is_blank(F.col("_text")), "blank listing")
        .otherwise("ready")
        .alias("state"),
    )
