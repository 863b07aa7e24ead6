"""The whole translation run of a set of books as one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave import schemas
from glossweave.functions.text import is_blank, tier
from glossweave.operators.gate import all_empty_books
from glossweave.operators.inference import Model, translate_fresh
from glossweave.operators.memory import lookup, marks, upsert, with_hits
from glossweave.operators.paragraphs import mark_repeats
from glossweave.session import stored


@dataclass
class TranslationRun:
    segments: DataFrame  # every paragraph of the other books with its translation and origin
    memory: DataFrame  # new memory snapshot
    failed_books: DataFrame  # books that came back all blank: no segments, nothing learned


def translate_books(
    paragraphs: DataFrame, memory: DataFrame, model: Model, use_memory: bool = True,
    answers: str | None = None,
) -> TranslationRun:
    """Tier and fold repeats, look up the memory, translate the rest, spread to repeats.

    `paragraphs` holds `(book_id, pos, text)`. Repeats of a short text follow their first
    occurrence, whether that came from the memory or from the model. A book whose new
    translations are all blank is stopped: it is in `failed_books`, gives no segments and
    teaches nothing. With the folder `answers` a rerun repeats no answered call.
    """
    # Paragraphs are made once and shipped once, with the hashes of the memory's texts. What was hit
    # lies apart from the rest, which goes when its answers are written.
    tiered = paragraphs.withColumn("tier", tier(F.col("text")))
    if use_memory:
        known = stored(marks(memory))
        looked = stored(with_hits(tiered, known.table), "hit")
        known.drop()
    else:
        looked = stored(tiered.withColumn("hit", F.lit(False)), "hit")
    is_short = F.col("tier") == schemas.TIER_SHORT
    shorts = stored(mark_repeats(looked.table.where(is_short), "book_id", "pos", tiered=True))
    columns = ["book_id", "pos", "text", "tier", "hit"]
    originals = shorts.table.where(~F.col("is_duplicate")).select(*columns).unionByName(
        looked.table.where(~is_short).select(*columns)
    )
    no_error = F.lit(None).cast("string").alias("error")
    cached = lookup(originals.where("hit").drop("hit"), memory).select(
        "book_id", "pos", F.col("text").alias("original"), "translated", "tier",
        F.lit("memory").alias("origin"), F.lit(False).alias("failed"),
        F.lit("ok").alias("action"), F.lit(0).alias("calls"), no_error,
    )
    fresh = translate_fresh(
        originals.where(~F.col("hit")).select("book_id", "pos", "text", "tier"), model, answers=answers
    ).withColumn("origin", F.lit("model"))
    empty = stored(all_empty_books(
        fresh.select(
            "book_id", F.lit(False).alias("is_duplicate"),
            F.when(F.col("action") == "keep_original", "").otherwise(F.col("translated"))
            .alias("translated"),
        )
    )).table
    repeats = shorts.table.where("is_duplicate").select(
        "book_id", "pos", F.col("first_pos"), "text", "tier"
    )
    # Where first occurrences are: of short texts, and of longer ones only if they share a place with one.
    firsts = repeats.select("book_id", F.col("first_pos").alias("pos")).distinct()
    shared = stored(
        looked.table.where(~is_short).select("book_id", "pos").distinct().join(firsts, ["book_id", "pos"], "left_semi")
    ).table
    looked.drop("hit=false")
    done = cached.unionByName(fresh.drop("issues"))
    asked = done.where(is_short).unionByName(done.where(~is_short).join(shared, ["book_id", "pos"], "left_semi"))
    copied = repeats.join(
        asked.select("book_id", F.col("pos").alias("first_pos"), "translated", "failed"),
        ["book_id", "first_pos"],
        "left",
    ).select(
        "book_id", "pos", F.col("text").alias("original"), "translated", "tier",
        F.lit("repeat").alias("origin"), "failed", F.lit("ok").alias("action"),
        F.lit(0).alias("calls"), no_error,
    )
    segments = done.unionByName(copied).join(empty, "book_id", "left_anti")
    # The model's word goes to the memory, not the original kept in its place.
    given = (F.col("action") != "keep_original") & ~is_blank(F.col("translated"))
    learned = fresh.where(given).join(empty, "book_id", "left_anti").select(
        F.col("original").alias("source_text"), F.col("translated").alias("translated_text"),
        F.struct("book_id", "pos").alias("place"),
    )
    return TranslationRun(segments, upsert(memory, learned, "place"), empty)


def run_stats(segments: DataFrame, by: list[str]) -> DataFrame:
    """Paragraphs, memory hits, calls' results and tiers of a run, in one pass."""
    origin, tier = F.col("origin"), F.col("tier")
    return segments.groupBy(*by).agg(
        F.count(F.lit(1)).alias("paragraphs"),
        F.count_if(origin == "memory").alias("cache_hits"),
        F.round(F.try_divide(F.count_if(origin == "memory") * 100.0, F.count(F.lit(1))), 1).alias(
            "hit_pct"
        ),
        F.count_if(origin == "model").alias("translated"),
        F.sum("calls").cast("long").alias("api_calls"),
        F.count_if(origin == "repeat").alias("repeats"),
        F.count_if(F.col("action") == "retry").alias("retried"),
        F.count_if(F.coalesce("failed", F.lit(False))).alias("failed"),
        F.count_if(tier == schemas.TIER_SHORT).alias("tier1"),
        F.count_if(tier == schemas.TIER_NORMAL).alias("tier2"),
        F.count_if(tier == schemas.TIER_LONG).alias("tier3"),
    )


def with_token_rate(stats: DataFrame, usage: DataFrame, by: list[str]) -> DataFrame:
    """Add the tokens used and their average per translated paragraph."""
    used = usage.groupBy(*by).agg(
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens")
    )
    return stats.join(used, by, "left").withColumn(
        "avg_tokens", F.round(F.try_divide("total_tokens", "translated"), 1)
    )
