"""Translation memory: lookup, misses, duplicate fan-out, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.functions.text import is_blank, source_hash


def build_memory(entries: DataFrame, order: list[str]) -> DataFrame:
    """One entry per source hash: the earliest by `order`.

    A partial aggregate folds repeated texts before the shuffle.
    """
    return (
        entries.withColumn("source_hash", source_hash(F.col("original")))
        .groupBy("source_hash")
        .agg(
            F.min_by(
                F.struct("original", "translated"), F.struct(*order)
            ).alias("e")
        )
        .select(
            "source_hash",
            F.col("e.original").alias("source_text"),
            F.col("e.translated").alias("translated_text"),
        )
    )


def lookup(paragraphs: DataFrame, memory: DataFrame, text: str = "text") -> DataFrame:
    """Add `translated` (null on a miss) and `hit`.

    The key is the hash, narrow to compare; the text itself is checked too (see `_same`). A blank
    translation counts as a miss, so such entries are left out of the join.
    """
    usable = memory.where(~is_blank(F.col("translated_text"))).select(
        "source_hash", "source_text", F.col("translated_text").alias("translated")
    )
    keyed = paragraphs.withColumn("source_hash", source_hash(F.col(text)))
    return (
        keyed.join(
            usable,
            (keyed.source_hash == usable.source_hash) & _same(keyed[text], usable.source_text),
            "left",
        )
        .select(keyed["*"], "translated", F.col("translated").isNotNull().alias("hit"))
    )


def _same(left: Column, right: Column) -> Column:
    """Equality that is no key of a join: a memory dealt by its hash is not dealt anew by its texts."""
    return F.contains(left, right) & F.contains(right, left)


def marks(memory: DataFrame) -> DataFrame:
    """`(mark, check)`: hashes of the texts that `lookup` finds in the memory, each once.

    An entry whose hash is not that of its own text can't be found: `lookup` compares both.
    """
    source = F.col("source_text")
    usable = memory.where(~is_blank(F.col("translated_text")) & (F.col("source_hash") == source_hash(source)))
    return usable.select(_mark(source).alias("mark"), F.xxhash64(source).alias("check")).distinct()


def _mark(text: Column) -> Column:
    return F.unhex(F.md5(text))


def with_hits(paragraphs: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """Add `hit`, as `lookup` does, from the hashes that `marks` gives; no other text is shipped."""
    keyed = paragraphs.withColumn("mark", _mark(F.col(text))).withColumn("check", F.xxhash64(text))
    return keyed.join(known.withColumn("hit", F.lit(True)), ["mark", "check"], "left").select(
        *paragraphs.columns, F.coalesce("hit", F.lit(False)).alias("hit")
    )


def misses(paragraphs: DataFrame, memory: DataFrame, text: str = "text") -> DataFrame:
    usable = memory.where(~is_blank(F.col("translated_text"))).select(
        "source_hash", "source_text"
    )
    keyed = paragraphs.withColumn("source_hash", source_hash(F.col(text)))
    return keyed.join(
        usable,
        (keyed.source_hash == usable.source_hash) & (keyed[text] == usable.source_text),
        "left_anti",
    )


def fan_out(paragraphs: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Give duplicates the result of their original.

    `paragraphs` holds `keys`, `id`, `original_id` (null for originals); `results` holds
    `keys`, `id`, `translated` for originals, from the memory or fresh. Every paragraph
    keeps its row.
    """
    owner = F.coalesce("original_id", "id")
    done = results.select(*keys, F.col("id").alias("_owner"), "translated")
    return (
        paragraphs.withColumn("_owner", owner)
        .join(done, [*keys, "_owner"], "left")
        .drop("_owner")
    )


def upsert(memory: DataFrame, updates: DataFrame, order: str) -> DataFrame:
    """New memory snapshot: the last update per hash wins over the stored entry.

    `updates` holds `source_text`, `translated_text` and the column `order`.
    """
    latest = (
        updates.withColumn("source_hash", source_hash(F.col("source_text")))
        .groupBy("source_hash")
        .agg(F.max_by(F.struct("source_text", "translated_text"), order).alias("new"))
    )
    stored = memory.select(
        "source_hash",
        F.col("source_text").alias("_source"),
        F.col("translated_text").alias("_translated"),
    )
    return stored.join(latest, "source_hash", "full").select(
        "source_hash",
        F.coalesce("_source", "new.source_text").alias("source_text"),
        F.coalesce("new.translated_text", "_translated").alias("translated_text"),
        F.when(F.col("new").isNull(), "kept")
        .when(F.col("_source").isNull(), "inserted")
        .otherwise("updated")
        .alias("change"),
    )
