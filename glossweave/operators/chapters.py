"""Chapters: heading-delimited segmentation, fallbacks and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.functions import patterns as P
from glossweave.functions.text import strip
from glossweave.plans.scan import BLOCK_ROWS, first_rows, running_total, scan


def chapter_lines(
    nodes: DataFrame, book: str, order: str, rows: int = BLOCK_ROWS
) -> DataFrame:
    """Every content row with the number of its chapter, whole and in long form.

    `nodes` holds `tag` and `text`. A heading (h1-h3, 1 to 99 characters) opens a chapter;
    rows before the first one belong to chapter 0, the preface. Longer or empty headings
    carry no text into a chapter.
    """
    heading = F.col("tag").isin(P.HEADING_TAGS)
    opens = heading & (F.length("text") > 0) & (F.length("text") < P.HEADING_MAX)
    return running_total(
        nodes.withColumn("is_heading", opens), [book], order,
        F.col("is_heading").cast("long"), "chapter_no", rows,
    ).where(F.col("is_heading") | ~heading)


def chapters(lines: DataFrame, book: str, order: str) -> DataFrame:
    """One row per chapter with content: title, size and first 5000 characters.

    A chapter may hold any number of rows, so only rows that start within its first 5000
    characters are gathered; `chapter_lines` keeps the whole text.
    """
    filled = ~F.col("is_heading") & (F.length("text") > 0)
    sizes = (
        lines.groupBy(book, "chapter_no")
        .agg(
            F.max(F.when(F.col("is_heading"), strip(F.col("text")))).alias("title"),
            F.min(F.when(filled, F.col(order))).alias("start_pos"),
            F.count_if(filled).alias("n_lines"),
            F.sum(F.when(filled, F.length("text") + 1)).alias("n_chars"),
        )
        .where(F.col("n_lines") > 0)
    )
    heads = chapter_heads(lines.where(filled), book, order)
    return (
        sizes.join(heads, [book, "chapter_no"], "left")
        .select(
            book,
            "chapter_no",
            F.coalesce("title", F.lit(P.PREFACE)).alias("title"),
            "start_pos",
            "n_lines",
            "n_chars",
            "content",
        )
    )


def chapter_heads(
    content: DataFrame, book: str, order: str, chars: int = P.CHAPTER_CHARS
) -> DataFrame:
    """First `chars` characters of each chapter's lines, each ended by a line feed."""
    upto = running_total(
        content, [book, "chapter_no"], order, F.length("text") + 1, "_upto"
    )
    near = upto.where(F.col("_upto") - F.length("text") - 1 < chars)
    return near.groupBy(book, "chapter_no").agg(
        F.left(
            F.concat(
                F.array_join(
                    F.transform(
                        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "text"))),
                        lambda p: p.text,
                    ),
                    "\n",
                ),
                F.lit("\n"),
            ),
            F.lit(chars),
        ).alias("content")
    )


def fallback_chapters(items: DataFrame, book: str, order: str) -> DataFrame:
    """The first ten items of a book with more than 500 characters, as chapters.

    `items` holds `title` (may be null) and `text`; content is cut to 5000 characters.
    """
    long_items = items.where(F.length("text") > P.ITEM_MIN_CHARS).select(
        book, order, "title", F.left("text", F.lit(P.CHAPTER_CHARS)).alias("content")
    )
    number = F.row_number().over(_book_order(book, order))
    top = long_items.withColumn("chapter_no", number).where(
        F.col("chapter_no") <= P.CHAPTER_LIMIT
    )
    return top.select(
        book,
        F.col("chapter_no").cast("long").alias("chapter_no"),
        order,
        F.coalesce(
            "title", F.concat(F.lit("第"), F.col("chapter_no").cast("string"), F.lit("章"))
        ).alias("title"),
        "content",
    )


def _book_order(book: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(book).orderBy(order)


def context(
    found: DataFrame, book: str, n: int = 8, chars: int = P.CHAPTER_CHARS,
    layout: str = "prompt",
) -> DataFrame:
    """The first `n` chapters as one text: for the model (`title:` lines) or as a digest
    with `##` titles. Bounded by n x (chars + title)."""
    first = first_rows(found, [book], [F.col("chapter_no")], n)
    body = F.left("content", F.lit(chars))
    if layout == "prompt":
        piece = F.concat(F.col("title"), F.lit(":\n"), body)
    else:
        piece = F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), body)
    return first.groupBy(book).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("chapter_no", piece.alias("t")))),
                lambda p: p.t,
            ),
            "\n\n",
        ).alias("context")
    )


def suitability(
    chapters_: DataFrame, totals: DataFrame, book: str, min_chapters: int = 3,
    min_ratio: float = 0.5,
) -> DataFrame:
    """Per book: enough chapters, and enough of the text inside them.

    `totals` holds `(book, total_chars)`; a book without text fails the ratio.
    """
    per = chapters_.groupBy(book).agg(
        F.count(F.lit(1)).alias("n_chapters"), F.sum("n_chars").alias("content_chars")
    )
    joined = totals.join(per, book, "left").fillna(0, ["n_chapters", "content_chars"])
    ratio = F.try_divide("content_chars", "total_chars")
    return joined.select(
        book,
        "n_chapters",
        "content_chars",
        "total_chars",
        (F.col("n_chapters") >= min_chapters).alias("enough_chapters"),
        F.coalesce(ratio >= min_ratio, F.lit(False)).alias("enough_content"),
    )
