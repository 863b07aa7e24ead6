import pytest
from pyspark.sql import functions as F

from glossweave.functions import markdown, names, text
from glossweave.functions.similarity import similarity
from glossweave.operators import replies


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "given, want",
    [
        ("Book-Title--Some-Extra.epub", "Book-Title.epub"),
        ("Title  --  Extra.epub", "Title.epub"),
        ("Trailing Space .epub", "Trailing Space.epub"),
        ("x" * 70 + ".epub", "x" * 60 + ".epub"),
    ],
)
def test_fix_stem(spark, given, want):
    assert one(spark, names.fix_stem(F.col("f")), f=given) == want


@pytest.mark.parametrize(
    "given, want",
    [
        ("Figure 1.1 Overview", "tier1_short_repeatable"),
        ("appendix b", "tier1_short_repeatable"),
        ("1.1 Introduction", "tier1_short_repeatable"),
        ("a) item", "tier1_short_repeatable"),
        ("Figurative speech", "tier2_normal"),
        ("Chapter 1 " + "x" * 30, "tier2_normal"),
        ("y" * 200, "tier3_long_complex"),
    ],
)
def test_tier(spark, given, want):
    assert one(spark, text.tier(F.col("t")), t=given) == want


def test_white_space_is_pythons(spark):
    odd = "\x1c a \t b　\n\x85c​ "
    assert one(spark, text.squeeze(F.col("t")), t=odd) == " ".join(odd.split())
    assert one(spark, text.strip(F.col("t")), t=odd) == odd.strip()


def test_fold_and_signature(spark):
    assert one(spark, text.fold(F.col("t")), t="“A”—‘b’…  c") == "\"A\"-'b'... c"
    assert one(spark, text.signature(F.col("t")), t="Ab, Ç-9 中!") == "abç9中"


def test_labels_and_escape(spark):
    assert one(spark, text.strip_leading_label(F.col("t")), t="Part 1. Mindset") == "Mindset"
    assert one(spark, text.strip_leading_label(F.col("t")), t="1.2 Scope") == "Scope"
    assert one(spark, text.html_escape(F.col("t")), t="<a href=\"x\">'&'") == (
        "&lt;a href=&quot;x&quot;&gt;&#39;&amp;&#39;"
    )


def test_fill_leaves_other_braces(spark):
    filled = text.fill(F.lit(":root { --x: 1 } {title}"), title=F.col("t"))
    assert one(spark, filled, t="T") == ":root { --x: 1 } T"


def test_similarity(spark):
    from difflib import SequenceMatcher

    assert one(spark, similarity(F.col("a"), F.col("b")), a=" Same ", b="same") == 1.0
    assert one(spark, similarity(F.col("a"), F.col("b")), a="", b="any") == 0.8
    want = SequenceMatcher(None, "deep work", "work deeply").ratio()
    assert one(spark, similarity(F.col("a"), F.col("b")), a="Deep Work", b="Work deeply") == want


def test_markdown(spark):
    md = "# T\n```\n# code\n```\n**b** and `c`\n## S \n\n```py\nopen"
    plain = one(spark, markdown.plain_lines(F.col("t")), t=md)
    assert plain == ["# T", "b and c", "## S ", ""]
    heads = one(spark, markdown.headings(F.col("t")), t=md)
    assert [(h.level, h.label) for h in heads] == [("h1", "T"), ("h1", "code"), ("h2", "S")]


def test_markdown_blocks_over_small_blocks(spark):
    lines = ["# T", "|a|b|", "|--|:-:|", "|1|2|", "after", "|x|y|", "- one", "> quoted", "> next",
             "1. n", "", "---", "```", "# in code", "```", "***", "text"]
    df = spark.createDataFrame([(1, n, t) for n, t in enumerate(lines)], "k int, line_no int, line string")
    got = markdown.block_lines(df, ["k"], "line_no", "line", rows=2).orderBy("line_no").collect()
    assert [r.kind for r in got] == [
        "h3", "table_head", "table_separator", "table_row", "p", "table_head", "ul", "p", "quote",
        "ol", "blank", "rule", "fence", "code", "fence", "rule", "p",
    ]


def test_reply_parsing(spark):
    df = spark.createDataFrame(
        [(1, "Sure\n[1] one\n[2]  two \n[1] again"), (2, "no marks"), (3, "[2] only")], "k int, reply string"
    )
    got = {(r.k, r.item_no): r.translated for r in replies.parse_replies(df, ["k"]).collect()}
    assert got == {(1, 1): "again", (1, 2): "two", (3, 2): "only"}


def test_page_replies(spark):
    good = '```json\n{"page1": [1], "page2": [{"a": 1}], "page3": {"b": 2}, "page4": "x"}\n```'
    df = spark.createDataFrame([(1, good), (2, "sorry"), (3, '{"page1": 1, "page2": 2}')], "k int, reply string")
    got = {r.k: r for r in replies.parse_pages(df, ["k"]).collect()}
    assert (got[1].error, got[1].page1, got[1].page2) == (None, "[1]", '{"items":[{"a":1}]}')
    assert got[2].error == "not json"
    assert got[3].error == "missing page3"
    content = replies.summary_content(F.col("t"))
    assert one(spark, content, t='x {"content": "c"} y') == "c"
    assert one(spark, content, t="# head") == "# head"


def test_metadata_values(spark):
    df = spark.createDataFrame(
        [(["A", "B"], ["C"]), ([], ["C"]), (None, None)], "a array<string>, c array<string>"
    )
    got = [r.x for r in df.select(text.metadata_author(F.col("a"), F.col("c")).alias("x")).collect()]
    assert got == ["A", "C", None]
