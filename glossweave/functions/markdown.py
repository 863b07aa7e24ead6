"""Markdown line functions; a text stays one row, so nothing here shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.functions import patterns as P
from glossweave.functions.text import strip
from glossweave.plans.scan import BLOCK_ROWS, scan

# A fence line, the lines up to the closing fence, and that fence (or the end). The
# reluctant dot keeps the match iterative, so long blocks do not deepen the stack.
_INDENT = r"[\p{IsWhite_Space}\x1c-\x1f&&[^\n]]*"
_FENCED = rf"(?ms)^{_INDENT}```[^\n]*(?:\n.*?^{_INDENT}```[^\n]*|.*?\z)(?:\n|\z)"


def without_fences(text: Column) -> Column:
    return F.regexp_replace(text, _FENCED, "")


def plain_lines(text: Column) -> Column:
    """Lines outside code fences without bold, italic and code marks."""
    marked = without_fences(F.concat(text, F.lit("\n")))
    lines = F.split(F.regexp_replace(marked, r"\n\z", ""), "\n")
    lines = F.when(F.length(marked) == 0, F.array().cast("array<string>")).otherwise(lines)

    def unmark(line: Column) -> Column:
        line = F.regexp_replace(line, r"\*\*([^*]+)\*\*", "$1")
        line = F.regexp_replace(line, r"\*([^*]+)\*", "$1")
        return F.regexp_replace(line, "`([^`]+)`", "$1")

    return F.transform(lines, unmark)


def headings(text: Column) -> Column:
    """`#`, `##`, `###` lines as (level, label); fences are not looked at."""

    def entry(line: Column) -> Column:
        return F.when(
            line.startswith("## "), _heading("h2", line, 4)
        ).when(line.startswith("### "), _heading("h3", line, 5)).when(
            line.startswith("# "), _heading("h1", line, 3)
        )

    return F.filter(F.transform(F.split(text, "\n"), entry), lambda e: e.isNotNull())


def _heading(level: str, line: Column, start: int) -> Column:
    rest = strip(F.substr(line, F.lit(start)))
    return F.struct(F.lit(level).alias("level"), rest.alias("label"))


def _is_row(body: Column) -> Column:
    return body.startswith("|") & (F.instr(F.substr(body, F.lit(2)), "|") > 0)


def _is_separator(body: Column) -> Column:
    """No cell holds anything but dashes, colons and spaces."""
    parts = F.split(body, r"\|")
    cells = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    return F.forall(cells, lambda c: F.length(F.regexp_replace(strip(c), "[-: ]", "")) == 0)


def blocks(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per line of each text: `(keys, line_no, kind, line)`.

    Lines are right-stripped and freed of tags. Code fences, open tables and open lists
    reach over lines, so the lines are scanned in position blocks.
    """
    lines = F.transform(
        F.split(F.col(text), "\n"),
        lambda line: F.regexp_replace(
            F.rtrim(line, F.lit(P.SPACE_CHARS)), "<[^>]+>", ""
        ),
    )
    return block_lines(
        texts.select(*keys, F.posexplode(lines).alias("line_no", "line")),
        keys, "line_no", "line",
    )


def block_lines(
    lines: DataFrame, keys: list[str], order: str, line: str, rows: int = BLOCK_ROWS
) -> DataFrame:
    """`blocks` for lines that are rows already."""
    text = F.col(line)
    body = strip(text)
    fence = text.startswith("```")
    fenced = scan(
        lines.withColumn("_fence", fence), keys, order,
        totals={"_fences": F.col("_fence").cast("int")}, rows=rows,
    )
    code = (F.col("_fences") % 2 == 1) & ~F.col("_fence")
    row, separator = _is_row(body), _is_separator(body)
    kind = (
        F.when(F.col("_fence"), "fence")
        .when(code, "code")
        .when(row & separator, "table_separator")
        .when(row, "table_row")
        .when(text.startswith("### "), "h4")
        .when(text.startswith("## "), "h2")
        .when(text.startswith("# "), "h3")
        .when(body.startswith("- ") | body.startswith("* "), "ul")
        .when(body.rlike(rf"\A{P.DIGIT}+\.{P.SPACE}"), "ol")
        .when(text.startswith(">"), "quote")
        .when(body.isin("---", "***", "___"), "rule")
        .when(F.length(body) > 0, "p")
        .otherwise("blank")
    )
    own = F.col("_kind")
    table = F.when(own == "table_row", 1).when(
        ~own.isin("fence", "code", "table_separator"), 0
    )
    listing = F.when(own.isin("ul", "ol"), 1).when(
        own.isin("quote", "rule", "p", "blank"), 0
    )
    opened = scan(
        fenced.withColumn("_kind", kind), keys, order,
        last={"_table": table, "_list": listing}, rows=rows,
    )
    # The first row of a table is its head; the line that ends a list is plain text.
    final = (
        F.when((own == "table_row") & (F.coalesce("_table", F.lit(0)) == 0), "table_head")
        .when(own.isin("quote", "rule") & (F.coalesce("_list", F.lit(0)) == 1), "p")
        .otherwise(own)
    )
    return opened.select(*keys, order, final.alias("kind"), line)
