"""Mix sources to target weights: capped water-filling and seeded repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossweave.llm.common import fresh, written

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the order key that name a block; 4096 blocks a source.
BLOCK_DIGITS = 3


def word_count(text: Column) -> Column:
    """Number of words, 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], epochs: int) -> DataFrame:
    """Per source (columns source, source_size) its target.

    Sources by code point, null last, take the weights in turn and share the sum of all sizes
    by weight. A source whose share is over `epochs` times its size stops there and what it
    leaves goes to the others by weight, until none is above. Sources reach their cap in the
    order of cap / weight, so running sums in that order give the final level at once. `sizes`
    has one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("long"))
    rows = rows.withColumn("cap", F.col("source_size") * epochs)
    order = [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rows = rows.withColumn("all", F.sum("source_size").over(everything))
    rows = rows.withColumn("rest", F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    rows = rows.withColumn("shares", F.sum("weight").over(after))
    # The first source in this order that stays at or below its cap, and all after it, share.
    shares = F.col("rest") * F.col("weight") <= F.col("cap") * F.col("shares")
    rows = rows.withColumn("open", F.max(shares).over(Window.orderBy(*order)))
    level = F.struct("rest", "shares")
    rows = rows.withColumn("level", F.first(F.when(F.col("open"), level), True).over(
        Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ))
    target = F.when(
        F.col("open"), F.col("level.rest") * F.col("weight").cast("double") / F.col("level.shares")
    ).otherwise(F.col("cap").cast("double"))
    return rows.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    size: Column,
    source_col: str = "source",
    key_col: str = "doc_id",
    weights: Sequence[int] = (5, 2, 1),
    epochs: int = 3,
    seed: str = "mix",
) -> DataFrame:
    """`docs` with size, source_size, target and repeats (how often the mix takes the row).

    `size` (not null, not negative) may be any column of `docs`, such as word_count. A source's rows are put in a seeded order (md5 of seed and key; ties by
    size); each is taken target / source_size times: the whole part always, the
    fraction for rows whose middle lies in the first part of that order that fills the target,
    so what is taken differs from the target by about one row. Running sums are taken within
    4096 blocks of a source and over the blocks, so that no source is one group. Rows of
    size 0 are taken as often as the order says and add nothing. Null sources are one source. Columns with these names are replaced; repeated rows stay.
    """
    names = ("size", "source_size", "target", "repeats")
    kept = [c for c in docs.columns if c not in names]
    order, block, source, of_source, of_block, begin = fresh(
        docs, "order_key", "block", "source_name", "of_source", "of_block", "begin"
    )
    rows = docs.withColumns({
        "size": size.cast("long"),
        source: F.coalesce(F.concat(F.lit("="), docs[source_col].cast("string")), F.lit("")),
        order: F.md5(F.concat_ws(":", F.lit(seed), docs[key_col].cast("string")).cast("binary")),
    }).withColumn(block, F.substring(order, 1, BLOCK_DIGITS))
    blocks = written(rows.groupBy(source, block).agg(F.sum("size").alias("block_size")))
    plan = targets(
        blocks.groupBy(F.expr(f"substring(nullif({source}, ''), 2)").alias("source")).agg(F.sum("block_size").alias("source_size")),
        weights, epochs,
    )
    ahead = Window.partitionBy(source).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    begins = blocks.select(
        F.col(source).alias(of_source), F.col(block).alias(of_block),
        F.coalesce(F.sum("block_size").over(ahead), F.lit(0)).alias(begin),
    )
    begins = begins.join(plan, F.expr(f"substring(nullif({of_source}, ''), 2) <=> source"))
    begins = written(begins.select(of_source, of_block, begin, "source_size", "target"))
    joined = rows.drop("source_size", "target", "repeats").join(
        begins, (F.col(source) == F.col(of_source)) & (F.col(block) == F.col(of_block))
    )
    inside = Window.partitionBy(source, block).orderBy(order, "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    middle = F.col(begin) + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio)
    fraction = F.col("target") - whole * F.col("source_size")
    repeats = (whole + F.when(middle < fraction, 1).otherwise(0)).cast("long")
    return joined.select(
        *[F.col(f"`{c}`") for c in kept], "size", "source_size", "target", repeats.alias("repeats")
    )
