"""Text functions: Column in, Column out, all inside whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossweave import schemas
from glossweave.functions import patterns as P


def strip(text: Column) -> Column:
    """Drop white space of any kind at both ends."""
    return F.trim(text, F.lit(P.SPACE_CHARS))


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.length(strip(text)) == 0)


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def _holds(text: Column, marks: list[str]) -> Column:
    found = [F.contains(text, F.lit(mark)) for mark in marks]
    return reduce(Column.__or__, found)


def squeeze(text: Column) -> Column:
    """Collapse runs of white space to one space and strip the ends.

    The pattern is slow, so it only sees texts with anything but single spaces.
    """
    odd = [c for c in P.SPACE_CHARS if c != " "]
    uneven = _holds(text, ["  ", *[c for c in odd if c.isascii()]]) | (
        ~is_ascii(text) & _holds(text, [c for c in odd if not c.isascii()])
    )
    return F.trim(
        F.when(uneven, F.regexp_replace(text, f"{P.SPACE}{{2,}}|{P.NOT_BLANK_SPACE}", " "))
        .otherwise(text)
    )


def fold(text: Column) -> Column:
    """`squeeze` after folding typographic dashes, quotes and the ellipsis to ASCII."""
    # All that is folded lies outside ASCII, and no white space comes or goes with it.
    plain = squeeze(text)
    for mark, ascii_mark in P.FOLDED:
        plain = F.replace(plain, F.lit(mark), F.lit(ascii_mark))
    return F.when(is_ascii(text), squeeze(text)).otherwise(plain)


def without_spaces(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def signature(text: Column, chars: int = P.SIGNATURE_CHARS) -> Column:
    """Lower-case letters and digits of the first `chars` characters."""
    head = F.lower(F.left(text, F.lit(chars)))
    return F.when(is_ascii(text), F.regexp_replace(head, "[^a-z0-9]+", "")).otherwise(
        F.regexp_replace(head, r"[^\p{L}\p{N}]+", "")
    )


def strip_leading_label(text: Column) -> Column:
    """Drop one leading `Part 3.`, `Appendix B.` or `1.2` from a heading."""
    return strip(F.regexp_replace(text, "(?iu)" + P.LEADING_LABEL, ""))


def tier(text: Column) -> Column:
    """Short repeatable, normal or long paragraph."""
    stripped = strip(text)
    return (
        F.when(
            (F.length(stripped) <= P.SHORT_MAX) & stripped.rlike("(?iu)" + P.SHORT_FORM),
            schemas.TIER_SHORT,
        )
        .when(F.length(stripped) >= P.LONG_MIN, schemas.TIER_LONG)
        .otherwise(schemas.TIER_NORMAL)
    )


def trans_id(item_id: Column, text: Column) -> Column:
    return F.substring(F.md5(F.concat(item_id, F.lit("_"), text)), 1, 12)


def source_hash(text: Column) -> Column:
    return F.md5(text)


def truncate(text: Column, chars: int = 100, suffix: str = "...") -> Column:
    return F.when(F.length(text) <= chars, text).otherwise(
        F.concat(F.left(text, F.lit(chars - len(suffix))), F.lit(suffix))
    )


def html_escape(text: Column) -> Column:
    for raw, entity in (
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"),
    ):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def strip_tags(text: Column) -> Column:
    """Line breaks become a space, every other tag goes, emphasis becomes <b>, <i>, font."""
    text = F.regexp_replace(text, rf"(?i)<br{P.SPACE}*/?>", " ")
    text = F.regexp_replace(text, "<[^>]+>", "")
    text = F.regexp_replace(text, r"\*\*([^\n]+?)\*\*", "<b>$1</b>")
    text = F.regexp_replace(text, r"\*([^\n]+?)\*", "<i>$1</i>")
    text = F.regexp_replace(text, r"`([^\n]+?)`", '<font name="Courier">$1</font>')
    return strip(text)


def fill(template: Column, **values: Column) -> Column:
    """Replace `{name}` for the given names only; other braces stay."""
    for name, value in values.items():
        template = F.replace(
            template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit(""))
        )
    return template


def book_kind(title: Column) -> Column:
    lowered = F.lower(F.coalesce(title, F.lit("")))
    kind = None
    for name, words in P.BOOK_KINDS:
        found = lowered.rlike("|".join(words))
        kind = F.when(found, name) if kind is None else kind.when(found, name)
    return kind.otherwise(P.BOOK_KIND_OTHER)


def summary_text(title: Column, author: Column, kind: Column, content: Column) -> Column:
    empty = F.lit("")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("书名："), F.coalesce(title, empty)),
        F.concat(F.lit("作者："), F.coalesce(author, empty)),
        F.concat(F.lit("类型："), F.coalesce(kind, empty)),
        empty,
        F.coalesce(content, empty),
    )


def first_of(values: Column) -> Column:
    """First value of a repeated metadata field, null when there is none."""
    return F.get(values, F.lit(0))


def metadata_author(authors: Column, creators: Column) -> Column:
    """First author; the creators count only where no author is given at all."""
    return first_of(
        F.when(F.size(F.coalesce(authors, F.array().cast("array<string>"))) > 0, authors)
        .otherwise(creators)
    )


def toc_labels(ncx: Column) -> Column:
    return F.regexp_extract_all(ncx, F.lit("<text>([^<]+)</text>"), 1)


def is_toc_body(label: Column, book_title: Column) -> Column:
    """True for entries of the book's body: no front matter, page number or own title."""
    label = strip(label)
    title = F.lower(strip(F.coalesce(book_title, F.lit(""))))
    return (
        (F.length(label) > 0)
        & ~label.rlike(P.TOC_SKIP)
        & ~label.rlike(P.ROMAN)
        & ~label.rlike(rf"\A{P.DIGIT}+\z")
        & ((title == "") | (F.lower(label) != title))
    )
