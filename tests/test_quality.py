"""Scorers on small hand-made books."""

import pytest
from pyspark.sql import functions as F

from glossweave.operators import quality

MEM = "book_id string, pos int, original string, translated string"
SRC = "book_id string, pos int, text string"
TGT = "book_id string, pos int, translated string"


def memory(spark, *pairs):
    return spark.createDataFrame([("b", n, s, t) for n, (s, t) in enumerate(pairs)], MEM)


def sources(spark, *texts):
    return spark.createDataFrame([("b", n, t) for n, t in enumerate(texts)], SRC)


def targets(spark, *texts):
    return spark.createDataFrame([("b", n, t) for n, t in enumerate(texts)], TGT)


def test_fidelity_and_completeness(spark):
    full = quality.source_counts(
        sources(spark, "Hello World", "Good Morning"),
        memory(spark, ("Hello World", "你好世界"), ("Good Morning", "早上好")),
    )
    row = quality.fidelity(full).first()
    assert row.score >= 90 and row.missing_count == 0
    assert quality.completeness(full).first().score == 100

    part = quality.source_counts(sources(spark, "Hello", "World", "Test"), memory(spark, ("Hello", "你好")))
    row = quality.fidelity(part).first()
    assert row.score < 100 and row.missing_count == 2
    assert quality.completeness(part).first().score == 33.3

    empty = quality.source_counts(sources(spark, "Hello"), memory(spark, ("Hello", "")))
    row = quality.fidelity(empty).first()
    assert row.score < 50 and row.empty_count == 1


def test_first_entry_wins(spark):
    counts = quality.source_counts(
        sources(spark, " Hello "), memory(spark, ("Hello", ""), (" Hello", "你好"))
    ).first()
    assert (counts.n_empty, counts.n_translated) == (1, 0)


def reference_fluency(text):
    """The score's definition on one joined text."""
    import re

    text = text.strip()
    if not text:
        return 100
    script = len(re.findall(r"[一-鿿㐀-䶿　-〿＀-￯]", text))
    words = [w for w in re.findall(r"\b[a-zA-Z]{2,}\b", text) if not w.startswith(("http", "www"))]
    ratio = script / len(text)
    score = min(50, ratio * 50) + max(0, 20 - 5 * len(words))
    if ratio > 0:
        score += min(30, script / max(1, len(text) - 5 * len(words)) * 30)
    return round(min(100, score), 1)


@pytest.mark.parametrize(
    "texts",
    [
        ["今天天气很好，适合出去散步。我们一起去公园吧！"],
        ["这个功能需要 review 一下，然后 deploy 到 server"],
        ["Hello world, this is English text."],
        ["", " "],
        ["　　", "", "　你好", "x", "　", "再见　 ", " 　"],
        ["部署deploy到 server 上", "http www wwwx"],
    ],
)
def test_fluency_adds_up_over_paragraphs(spark, texts):
    row = quality.fluency(quality.target_counts(targets(spark, *texts))).first()
    assert row.score == pytest.approx(reference_fluency("\n".join(texts)), abs=0.11)


def test_fluency_bounds(spark):
    row = quality.fluency(quality.target_counts(targets(spark, "今天天气很好，适合出去散步。"))).first()
    assert row.score >= 90 and row.chinese_ratio > 0.9 and row.english_word_count == 0
    row = quality.fluency(quality.target_counts(targets(spark, "Hello world, this is English text."))).first()
    assert row.score == 0 and row.chinese_ratio == 0


def test_consistency(spark):
    good = quality.consistency(memory(spark, ("Apple", "苹果"), ("apple ", "苹果"), ("Banana", "香蕉"))).first()
    assert (good.score, good.total_terms) == (100, 2)
    bad = quality.consistency(memory(spark, ("Apple", "苹果"), ("apple ", "平果"), ("Banana", "香蕉"))).first()
    assert (bad.score, bad.inconsistent_terms) == (50, 1)
    assert bad.issues == ["有 1 个术语翻译不一致: 'apple'→2 种译法"]


def test_terminology(spark):
    terms = quality.glossary(spark)
    good = quality.terminology(memory(spark, ("API", "API"), ("database", "数据库")), terms).first()
    assert good.score >= 90
    bad = quality.terminology(memory(spark, ("API", "应用程序")), terms).first()
    assert bad.incorrect_count == 1 and bad.issues[0].endswith("(期望: 'API')")
    none = quality.terminology(memory(spark, ("other", "别的")), terms).first()
    assert (none.score, none.total_terms) == (100, 0)


@pytest.mark.parametrize(
    "text, field",
    [("会议在 01/15/2024 举行", "western_date_count"), ("长 15 inches，重 2 pounds", "imperial_units"),
     ("价格 $5", "western_currency")],
)
def test_cultural(spark, text, field):
    row = quality.cultural(quality.target_counts(targets(spark, text))).first()
    assert row[field] > 0 and row.score < 100
    clean = quality.cultural(quality.target_counts(targets(spark, "2024年1月15日，我们见面。"))).first()
    assert clean.score == 100


def test_format(spark):
    def check(src, tgt):
        return quality.format_integrity(
            quality.source_counts(sources(spark, *src), memory(spark, ("x", "y"))),
            quality.target_counts(targets(spark, *tgt)),
        ).first()

    same = ["# T", "- a", "1. b", "text"]
    assert check(same, same).score == 100
    less = check(["a", "b", "c"], ["a", "b"])
    assert less.score < 100 and not less.para_count_match


def test_toc_links(spark):
    entries = spark.createDataFrame(
        [("b", "x", 1, 10), ("b", "x", 11, 10), ("b", "y", 10, 10)],
        "book_id string, edition string, page int, page_count int",
    )
    editions = spark.createDataFrame([("b", "x"), ("b", "y"), ("c", "x")], "book_id string, edition string")
    got = {r.book_id: r.score for r in quality.toc_links(entries, editions).collect()}
    assert got == {"b": 75.0, "c": 0.0}


def test_report_and_json(spark):
    rows = quality.dimensions(
        sources(spark, "Hello"), targets(spark, "你好世界"), memory(spark, ("Hello", "你好世界"))
    )
    assert rows.count() == 7
    books = spark.createDataFrame([("b", "T"), ("none", "N")], "book_id string, title string")
    report = quality.overall(books, rows)
    got = {r.book_id: r for r in report.collect()}
    assert got["b"].overall_grade == "优秀" and got["b"].n_dimensions == 7
    assert got["none"].overall_grade == "无法评估" and got["none"].overall_score == 0
    back = quality.read_report_json(quality.report_json(report, rows)).where("book_id = 'b'").first()
    assert back.overall_score == got["b"].overall_score
    assert back.dimensions["fluency"].score == 100.0


def test_grades(spark):
    df = spark.createDataFrame([(95.0,), (90.0,), (80.0,), (60.0,), (59.9,)], "s double")
    got = [r.g for r in df.select(quality.grade(F.col("s")).alias("g")).collect()]
    assert got == ["优秀", "优秀", "良好", "合格", "需改进"]


def test_mean_of_scores_is_exact(spark):
    """The mean ends in 5 at the second decimal, which a sum of doubles misses."""
    scores = [87.3, 89.7, 60.5, 76.9, 86.9, 62.7, 74.2, 53.4]
    rows = spark.createDataFrame(
        [(1, d, s, []) for d, s in zip(quality.DIMENSIONS, scores)],
        "book_id long, dimension string, score double, issues array<string>",
    ).coalesce(1)
    books = spark.createDataFrame([(1, "a")], "book_id long, title string")
    assert quality.overall(books, rows).first().overall_score == 74.0
