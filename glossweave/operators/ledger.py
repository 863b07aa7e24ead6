"""Processing logs, publish failures and token usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.functions import patterns as P
from glossweave.plans.scan import scan

LOG_BLOCK = 1 << 22


def _publish_errors(logs: DataFrame) -> DataFrame:
    return logs.where((F.col("stage") == "publishing") & (F.col("status") == "error"))


def books_by_publish_status(books: DataFrame, outputs: DataFrame, status: str) -> DataFrame:
    wanted = outputs.where(F.col("publish_status") == status).select("book_id", "publish_status")
    return books.join(wanted, "book_id").orderBy(F.desc("created_seq"), "book_id")


def unbackfilled(outputs: DataFrame, logs: DataFrame) -> DataFrame:
    """Outputs still pending although publishing failed. A null status is not pending."""
    return outputs.where(F.col("publish_status") == "pending").join(
        _publish_errors(logs).select("book_id"), "book_id", "left_semi"
    )


def last_publish_errors(logs: DataFrame) -> DataFrame:
    """Latest publishing error per book; one partial aggregate, no sort."""
    newest = F.struct("created_at", "id")
    return _publish_errors(logs).groupBy("book_id").agg(
        F.max_by(F.struct("message", "created_at"), newest).alias("e")
    ).select(
        "book_id",
        F.col("e.message").alias("last_error"),
        F.col("e.created_at").alias("failed_at"),
    )


def backfill_failed(outputs: DataFrame, logs: DataFrame) -> DataFrame:
    """New snapshot of `outputs`: pending rows with a publishing error become failed, with
    the latest message. Running it on its own result changes nothing."""
    errors = last_publish_errors(logs)
    hit = (F.col("publish_status") == "pending") & F.col("failed_at").isNotNull()
    message = F.left(F.coalesce("last_error", F.lit("")), F.lit(P.ERROR_CHARS))
    hit = F.coalesce(hit, F.lit(False))
    kept = [c for c in outputs.columns if c not in ("publish_status", "publish_error")]
    return outputs.join(errors, "book_id", "left").select(
        *kept,
        F.when(hit, "failed").otherwise(F.col("publish_status")).alias("publish_status"),
        F.when(hit, message).otherwise(F.col("publish_error")).alias("publish_error"),
        hit.alias("was_backfilled"),
    )


def failed_report(books: DataFrame, outputs: DataFrame, logs: DataFrame) -> DataFrame:
    """Failed books with their error (80 characters) and the time of the last one."""
    failed = outputs.where(F.col("publish_status") == "failed").select(
        "book_id", F.coalesce("publish_error", F.lit("")).alias("publish_error")
    )
    error = F.concat(
        F.left("publish_error", F.lit(P.ERROR_PREVIEW)),
        F.when(F.length("publish_error") > P.ERROR_PREVIEW, "...").otherwise(""),
    )
    return (
        books.join(failed, "book_id")
        .join(last_publish_errors(logs), "book_id", "left")
        .select(
            "book_id", "created_seq",
            F.coalesce("title", F.lit("Unknown")).alias("title"),
            F.coalesce("author", F.lit("Unknown")).alias("author"),
            error.alias("error"),
            F.coalesce(F.date_format("failed_at", "yyyy-MM-dd HH:mm"), F.lit("-")).alias(
                "failed_at"
            ),
        )
    )


def latest_log(logs: DataFrame) -> DataFrame:
    """Latest entry per book and stage."""
    return logs.groupBy("book_id", "stage").agg(
        F.max_by(F.struct("id", "status", "message", "created_at"), F.struct("created_at", "id"))
        .alias("e")
    ).select("book_id", "stage", "e.*")


def run_outcome(logs: DataFrame, stage: str) -> DataFrame:
    """Success and failure counts of the latest runs of a stage, with the failed books."""
    latest = latest_log(logs.where(F.col("stage") == stage))
    return latest.groupBy(
        F.when(F.col("status") == "error", "failed").otherwise("success").alias("outcome")
    ).agg(F.count(F.lit(1)).alias("books"))


def run_failures(logs: DataFrame, stage: str) -> DataFrame:
    latest = latest_log(logs.where(F.col("stage") == stage))
    return latest.where(F.col("status") == "error").select(
        "book_id", F.left(F.coalesce("message", F.lit("")), F.lit(P.ERROR_PREVIEW)).alias("error")
    )


def seconds(later: Column, earlier: Column) -> Column:
    micros = F.expr("timestamp_ntz '1970-01-01 00:00:00'")
    return (
        F.timestamp_diff("MICROSECOND", micros, later)
        - F.timestamp_diff("MICROSECOND", micros, earlier)
    ) / F.lit(1000000.0)


def stage_durations(logs: DataFrame, order: str = "id", rows: int = LOG_BLOCK) -> DataFrame:
    """Time from each start entry to the next entry of the book's stage, per book and stage.

    `order` numbers the entries in time. A book may hold any number of entries, so the
    previous one is found by a blocked scan. The numbers run over all books, so a block
    holds more of them than a block of one book's positions.
    """
    place = F.struct("status", "created_at")
    paired = scan(logs, ["book_id", "stage"], order, last={"_before": place}, rows=rows)
    ended = paired.where(
        (F.col("_before.status") == "start") & (F.col("status") != "start")
    ).select(
        "book_id", "stage", seconds(F.col("created_at"), F.col("_before.created_at")).alias("s")
    )
    return ended.groupBy("book_id", "stage").agg(
        F.count(F.lit(1)).alias("runs"),
        F.round(F.sum("s"), 3).alias("total_seconds"),
        F.round(F.avg("s"), 3).alias("avg_seconds"),
        F.round(F.max("s"), 3).alias("max_seconds"),
    )


def first_failure(logs: DataFrame) -> DataFrame:
    """The stage at which each book failed first."""
    return logs.where(F.col("status") == "error").groupBy("book_id").agg(
        F.min_by(F.struct("stage", "message", "id"), F.struct("created_at", "id")).alias("e")
    ).select("book_id", "e.stage", "e.message", F.col("e.id").alias("log_id"))


def token_cost(input_tokens: Column, output_tokens: Column) -> Column:
    """Cost in currency units: 1.0 per million input and 2.0 per million output tokens."""
    return (
        input_tokens / 1000000 * P.PRICES["input"] + output_tokens / 1000000 * P.PRICES["output"]
    )


def with_cost(usage: DataFrame) -> DataFrame:
    cost = token_cost(F.col("input_tokens"), F.col("output_tokens"))
    return usage.withColumns(
        {
            "total_tokens": F.col("input_tokens") + F.col("output_tokens"),
            "cost": F.round(cost, 6),
        }
    )


def token_summary(usage: DataFrame, book: str | None = None) -> DataFrame:
    """Per step and in total, over all books or within each book.

    Costs are summed as decimals, so the order of rows does not matter.
    """
    costed = with_cost(usage).withColumn("cost", F.col("cost").cast("decimal(20,6)"))
    step = F.col("step")
    grouped = (
        costed.rollup(step)
        if book is None
        else costed.groupingSets([[F.col(book), step], [F.col(book)]], F.col(book), step)
    )
    return grouped.agg(
        F.grouping("step").alias("_all"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("cost").cast("double").alias("cost"),
    ).select(
        *([book] if book else []),
        F.when(F.col("_all") == 1, "TOTAL").otherwise(step).alias("step"),
        "input_tokens", "output_tokens", "total_tokens", "cost",
    )
