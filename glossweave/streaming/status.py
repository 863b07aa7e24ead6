"""Live totals from the log and token streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.operators.catalog import fold_status
from glossweave.operators.ledger import with_cost


def live_status(events: DataFrame) -> DataFrame:
    """Current status and last error per book; one state row per book.

    `events` holds `(book_id, seq, status, error_message)`. Use with `update` mode.
    """
    return fold_status(events)


def live_tokens(usage: DataFrame) -> DataFrame:
    """Token and cost totals per book and step."""
    return with_cost(usage).groupBy("book_id", "step").agg(
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        F.sum(F.col("cost").cast("decimal(20,6)")).alias("cost"),
    )
