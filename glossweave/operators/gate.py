"""Checks on single translated segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave import schemas
from glossweave.functions import patterns as P
from glossweave.functions.text import is_blank


def gate(segments: DataFrame, limits: dict = P.GATE) -> DataFrame:
    """Add `issues`, `action` and `final_text` to `(original, translated, tier)` rows.

    Actions: `keep_original` (blank translation), `keep` (too short, or a short text with
    another issue), `retry` (long text with an issue), `ok`.
    """
    original, translated = F.col("original"), F.col("translated")
    blank = is_blank(translated)
    n, m = F.length(original), F.length(translated)
    ratio = m / F.when(n > 0, n)
    long_tier = F.col("tier") == schemas.TIER_LONG
    short_text = n <= limits["short_max"]
    low = F.when(long_tier, limits["long_min_ratio"]).otherwise(limits["min_ratio"])
    high = F.when(long_tier, limits["long_max_ratio"]).otherwise(limits["max_ratio"])
    checked = ~blank & (n > 0)
    too_short = checked & F.when(short_text, m < limits["short_min_chars"]).otherwise(ratio < low)
    too_long = checked & F.when(
        short_text, ~long_tier & (ratio > limits["max_ratio"])
    ).otherwise(ratio > high)
    left_over = None
    for mark in P.RESIDUE:
        found = F.contains(translated, F.lit(mark))
        left_over = found if left_over is None else left_over | found
    residue = checked & left_over & ~original.rlike(P.CODE_MARK)
    issues = F.array_compact(
        F.array(
            F.when(blank, "空翻译"),
            F.when(too_short, "翻译过短"),
            F.when(too_long, "翻译过长"),
            F.when(residue, "分隔符残留"),
        )
    )
    return (
        segments.withColumn("length_ratio", F.when(checked, ratio))
        .withColumn("issues", issues)
        .withColumn("action", _action(blank, too_short, n, limits))
        .withColumn("final_text", F.when(blank, original).otherwise(translated))
    )


def _action(blank: Column, too_short: Column, n: Column, limits: dict) -> Column:
    return (
        F.when(blank, "keep_original")
        .when(too_short, "keep")
        .when(F.size("issues") == 0, "ok")
        .when(n > limits["retry_min"], "retry")
        .otherwise("keep")
    )


def accept_retry(old: Column, new: Column) -> Column:
    """A second translation counts when it is longer than half of the first."""
    return F.coalesce(F.length(new) > F.length(old) * 0.5, F.lit(False))


def all_empty_books(fresh: DataFrame) -> DataFrame:
    """Books all of whose fresh, non-duplicate translations are blank."""
    return (
        fresh.where(~F.col("is_duplicate"))
        .groupBy("book_id")
        .agg(
            F.bool_and(is_blank(F.col("translated"))).alias("all_empty"),
            F.count(F.lit(1)).alias("n_fresh"),
        )
        .where("all_empty")
        .select("book_id", "n_fresh")
    )
