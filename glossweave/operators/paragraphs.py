"""Elements to numbered, tiered and deduplicated paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave import schemas
from glossweave.functions import patterns as P
from glossweave.functions.text import squeeze, tier, trans_id


def tag_priority(tag: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in P.CONTENT_TAGS]), tag)


def is_excluded(tag: Column, classes: Column, elem_id: Column) -> Column:
    """Navigation and page furniture, by the element's own tag, classes and id."""
    mark = "(?iU)" + P.EXCLUDED_MARK
    return (
        tag.isin(P.EXCLUDED_TAGS)
        | F.exists(classes, lambda c: c.rlike(mark))
        | F.coalesce(elem_id, F.lit("")).rlike(mark)
    )


def elements(items: DataFrame, keys: list[str]) -> DataFrame:
    """One row per element with its exclusion flag."""
    one = items.select(*keys, F.explode_outer("elements").alias("e")).select(*keys, "e.*")
    return one.where(F.col("tag").isNotNull()).withColumn(
        "excluded", is_excluded(F.col("tag"), F.col("classes"), F.col("elem_id"))
    )


def paragraph_arrays(items: DataFrame, keys: list[str]) -> DataFrame:
    """Add to pages with element arrays (`sources.pages.with_elements`) the array `ps` of
    their paragraphs and the counts of content elements, seen and excluded.

    Paragraphs are ordered by tag priority, then by place in the page; `first` is the
    place of the first equal short text. A page is one row, so its elements are filtered,
    ordered and compared inside the row: no shuffle.
    """
    content = F.filter(F.col("elements"), lambda e: e.tag.isin(P.CONTENT_TAGS))
    marked = items.select(
        *keys,
        F.size(content).cast("long").alias("total_tags"),
        F.filter(content, lambda e: ~is_excluded(e.tag, e.classes, e.elem_id)).alias("_kept"),
    )
    texts = F.flatten(
        F.transform(
            "_kept",
            lambda e: F.transform(
                F.when(e.has_block, e.bare).otherwise(F.array(e.text)),
                lambda t: F.struct(
                    tag_priority(e.tag).alias("rank"), e.doc_pos.alias("doc_pos"),
                    e.tag.alias("tag"), t.alias("text"),
                ),
            ),
        )
    )
    # Loose texts of one block share rank and place; `nth` keeps them in page order.
    ordered = F.array_sort(
        F.transform(
            F.filter(texts, lambda p: F.length(p.text) >= P.MIN_TEXT),
            lambda p, i: F.struct(
                p.rank.alias("rank"), p.doc_pos.alias("doc_pos"), i.alias("nth"),
                p.tag.alias("tag"), p.text.alias("text"), tier(p.text).alias("tier"),
            ),
        )
    )
    shorts = F.filter(
        F.transform(
            "_ordered",
            lambda p, i: F.struct(p.text.alias("text"), i.alias("i"), p.tier.alias("tier")),
        ),
        lambda p: p.tier == schemas.TIER_SHORT,
    )
    numbered = F.transform(
        "_ordered",
        lambda p, i: F.struct(
            p.doc_pos.alias("doc_pos"), p.tag.alias("tag"), p.text.alias("text"),
            p.tier.alias("tier"),
            F.when(
                p.tier == schemas.TIER_SHORT,
                F.get(F.col("_shorts.i"), F.array_position("_shorts.text", p.text).cast("int") - 1),
            ).otherwise(i).alias("first"),
        ),
    )
    return (
        marked.withColumn("excluded_tags", F.col("total_tags") - F.size("_kept"))
        .withColumn("_ordered", ordered)
        .withColumn("_shorts", shorts)
        .select(*keys, "total_tags", "excluded_tags", numbered.alias("ps"))
    )


def page_paragraphs(items: DataFrame, keys: list[str]) -> DataFrame:
    """One row per paragraph of pages with element arrays; `keys` hold `item_id`.

    Short repeatable texts point at their first occurrence in the page.
    """
    item, idx, first = F.col("item_id"), F.col("idx"), F.col("p.first")
    # The outer form keeps the optimizer from testing the array's size beforehand, which
    # would build the array twice.
    rows = paragraph_arrays(items, keys).select(*keys, F.posexplode_outer("ps").alias("idx", "p"))
    return rows.where(idx.isNotNull()).select(
        *keys,
        F.concat_ws("_", item, idx).alias("id"),
        trans_id(item, F.col("p.text")).alias("trans_id"),
        idx.cast("long").alias("idx"),
        F.col("p.doc_pos").alias("doc_pos"),
        F.col("p.tag").alias("tag"),
        F.col("p.text").alias("text"),
        F.col("p.tier").alias("tier"),
        (first < idx).alias("is_duplicate"),
        F.when(first < idx, F.concat_ws("_", item, first)).alias("original_id"),
    )


def extraction_stats(items: DataFrame, keys: list[str]) -> DataFrame:
    """Per page: elements seen and excluded, duplicates, paragraphs per tier."""

    def count(test) -> Column:
        return F.size(F.filter("ps", test)).cast("long")

    return paragraph_arrays(items, keys).select(
        *keys,
        "total_tags",
        "excluded_tags",
        count(lambda p, i: p.first < i).alias("duplicates"),
        count(lambda p: p.tier == schemas.TIER_SHORT).alias("tier1"),
        count(lambda p: p.tier == schemas.TIER_NORMAL).alias("tier2"),
        count(lambda p: p.tier == schemas.TIER_LONG).alias("tier3"),
    )


def document_paragraphs(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of plain documents as `(book_id, pos, text)`, whitespace folded, short ones out."""
    lines = F.transform(
        F.split(F.col(text), "\n"),
        lambda line, i: F.struct(i.alias("pos"), squeeze(line).alias("text")),
    )
    kept = F.filter(lines, lambda p: F.length(p.text) >= P.MIN_TEXT)
    # The outer form, as in page_paragraphs: the lines are made once.
    rows = documents.select(F.col(key).alias("book_id"), F.explode_outer(kept).alias("p"))
    return rows.where(F.col("p").isNotNull()).select(
        "book_id", F.col("p.pos").alias("pos"), F.col("p.text").alias("text")
    )


def number_elements(
    leaves: DataFrame, item: str, tag: str, pos: str, span: int, rows: int | None = None
) -> DataFrame:
    """Number rows by tag priority, then position, within each item.

    For element tables that are rows already. `span` is an upper bound of `pos` within an
    item; it folds priority and position into one ordering number.
    """
    from glossweave.plans.scan import BLOCK_ROWS, row_numbers

    placed = leaves.withColumn(
        "_order", tag_priority(F.col(tag)).cast("long") * F.lit(span) + F.col(pos)
    )
    numbered = row_numbers(placed, [item], "_order", "_n", rows or BLOCK_ROWS)
    return numbered.withColumn("idx", F.col("_n") - 1).drop("_n", "_order")


def mark_repeats(
    paragraphs: DataFrame, item: str, order: str, text: str = "text", tiered: bool = False
) -> DataFrame:
    """Point short repeatable texts of an item at their first occurrence.

    The first place per text is a partial aggregate, so a text that makes up a large part
    of the rows is folded before it is shuffled; only short paragraphs take part. `tiered` rows hold
    their `tier` already.
    """
    rows = paragraphs if tiered else paragraphs.withColumn("tier", tier(F.col(text)))
    short = F.col("tier") == schemas.TIER_SHORT
    firsts = (
        rows.where(short).groupBy(item, text).agg(F.min(order).alias("first_" + order))
    )
    marked = rows.where(short).join(firsts, [item, text])
    rest = rows.where(~short).withColumn("first_" + order, F.col(order))
    return marked.unionByName(rest).withColumn(
        "is_duplicate", F.col("first_" + order) < F.col(order)
    )


def first_headings(items: DataFrame, keys: list[str]) -> DataFrame:
    """First non-empty h1-h3 or title shorter than 100 characters, per page."""
    titles = F.filter(
        F.col("elements"),
        lambda e: e.tag.isin(*P.HEADING_TAGS, "title")
        & (F.length(e.title) > 0)
        & (F.length(e.title) < P.HEADING_MAX),
    )
    return items.select(*keys, F.get(titles, F.lit(0)).getField("title").alias("title"))
