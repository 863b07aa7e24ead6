"""Numbered prompts and the model replies to them, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.functions import patterns as P
from glossweave.functions.text import strip

_MARK = rf"\[({P.DIGIT}+)\]{P.SPACE}*"


def compose(batches: DataFrame, keys: list[str], order: str, text: str = "text") -> DataFrame:
    """One prompt body per batch: `[1] …`, `[2] …`, with its token estimate.

    `keys` name a batch; a batch is bounded by the batch plan, so its list is short.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    numbered = F.transform(
        F.col("_items"),
        lambda item, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), item.t),
    )
    body = F.array_join(numbered, "\n\n")
    return (
        batches.groupBy(*keys)
        .agg(items.alias("_items"))
        .select(*keys, F.size("_items").cast("long").alias("n_items"), body.alias("prompt"))
        .withColumn(
            "max_tokens",
            F.least(F.length("prompt") * 2 + P.TOKEN_FLOOR, F.lit(P.TOKEN_CAP)).cast("long"),
        )
    )


def reply_items(reply: Column) -> Column:
    """Array of (n, t): the numbers of a reply's marks and the texts behind them, in order."""
    numbers = F.regexp_extract_all(reply, F.lit(_MARK), 1)
    texts = F.slice(F.split(reply, _MARK), F.lit(2), F.size(numbers))
    return F.arrays_zip(numbers.alias("n"), texts.alias("t"))


def item_text(items: Column, item_no: Column) -> Column:
    """The text of one item, of equal numbers the last one; null where no mark names it."""
    same = F.filter(items, lambda p: p.n.try_cast("int") == item_no)
    return strip(F.get(same, F.size(same) - 1).getField("t"))


def parse_replies(replies: DataFrame, keys: list[str]) -> DataFrame:
    """`(keys, item_no, translated)` from `(keys, reply)`; replies without marks give none.

    The text before the first mark is no item; of equal numbers the last one wins.
    """
    marked = replies.select(
        *keys, "reply", F.regexp_extract_all("reply", F.lit(_MARK), 1).alias("_numbers")
    )
    texts = F.slice(F.split("reply", _MARK), F.lit(2), F.size("_numbers"))
    rows = marked.select(
        *keys, F.posexplode(F.arrays_zip(F.col("_numbers").alias("n"), texts.alias("t"))).alias("_at", "p")
    ).select(
        *keys, "_at", F.col("p.n").try_cast("int").alias("item_no"), strip(F.col("p.t")).alias("t")
    )
    return (
        rows.where(F.col("item_no").isNotNull())
        .groupBy(*keys, "item_no")
        .agg(F.max_by("t", "_at").alias("translated"))
    )


def json_object(reply: Column) -> Column:
    """Text from the first `{` to the last `}`, after code fences are taken off."""
    text = F.regexp_replace(strip(reply), rf"\A```(?:json)?{P.SPACE}*", "")
    text = strip(F.regexp_replace(text, rf"{P.SPACE}*```\z", ""))
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.length(braces) > 0, braces).otherwise(text)


def parse_pages(replies: DataFrame, keys: list[str]) -> DataFrame:
    """Layout replies: `page1` to `page4` must be there; a page given as a list is wrapped
    as `{"items": …}` (not `page1`). Unreadable replies come with an `error`."""
    pages = ["page1", "page2", "page3", "page4"]
    parsed = replies.select(*keys, F.try_parse_json(json_object(F.col("reply"))).alias("v"))
    raw = {p: F.expr(f"to_json(try_variant_get(v, '$.{p}', 'variant'))") for p in pages}
    missing = F.array_compact(
        F.array(*[F.when(raw[p].isNull(), F.lit(p)) for p in pages])
    )
    wrapped = [
        (
            raw[p]
            if p == "page1"
            else F.when(
                raw[p].startswith("["), F.concat(F.lit('{"items":'), raw[p], F.lit("}"))
            ).otherwise(raw[p])
        ).alias(p)
        for p in pages
    ]
    error = F.when(F.col("v").isNull(), "not json").when(
        F.size("_missing") > 0, F.concat(F.lit("missing "), F.get("_missing", F.lit(0)))
    )
    return parsed.select("*", *wrapped, missing.alias("_missing")).select(
        *keys,
        error.alias("error"),
        *[F.when(error.isNull(), F.col(p)).alias(p) for p in pages],
    )


def summary_content(reply: Column) -> Column:
    """Content of a summary reply: markdown as it is, else the `content` of its JSON."""
    head = strip(reply)
    markdown = head.startswith("#") | head.startswith("- ")
    found = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    content = F.get_json_object(F.when(F.length(found) > 0, found), "$.content")
    return F.when(markdown, reply).otherwise(F.coalesce(content, reply))
