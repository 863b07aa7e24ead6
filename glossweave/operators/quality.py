"""Translation-quality scores per book, from counts that add up over paragraphs.

Everything is counted per paragraph and summed, so a book of any size is folded before it
is shuffled. Scores are then arithmetic on one row per book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.functions import patterns as P
from glossweave.functions.text import is_blank, strip
from glossweave.operators.align import by_trimmed_source
from glossweave.plans.scan import first_rows

DIMENSIONS = [
    "fidelity", "fluency", "consistency", "format", "terminology", "cultural",
    "completeness", "pdf_toc_links",
]


def _number(value: Column, digits: int) -> Column:
    return F.round(value, digits).cast(f"decimal(20,{digits})").cast("string")


def _issues(*issues: Column) -> Column:
    return F.array_compact(F.array(*issues))


def _count_issue(template: tuple[str, str], count: Column) -> Column:
    return F.when(
        count > 0, F.concat(F.lit(template[0]), count.cast("string"), F.lit(template[1]))
    )


# ---- source side: fidelity, completeness ---------------------------------------------


def source_counts(sources: DataFrame, memory: DataFrame) -> DataFrame:
    """Per book: paragraphs, list items, translated, missing and empty, length ratios."""
    aligned = by_trimmed_source(sources, memory)
    found = F.col("target").isNotNull()
    filled = found & (F.length("target") > 0)
    ratio = F.when(
        F.length("text") > 0, F.least(F.length("target") / F.length("text"), F.lit(3.0))
    ).otherwise(1.0)
    return aligned.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("n_source"),
        F.count_if(F.col("text").rlike(P.LIST_ITEM)).alias("source_lists"),
        F.count_if(filled).alias("n_translated"),
        F.count_if(found & (F.length("target") == 0)).alias("n_empty"),
        F.count_if(~found).alias("n_missing"),
        F.avg(F.when(filled, ratio)).alias("length_ratio"),
    )


def _fidelity() -> list[Column]:
    n, ratio = F.col("n_source"), F.col("length_ratio")
    score = F.least(
        F.lit(100.0),
        F.col("n_translated") / n * 40
        + F.greatest(F.lit(0.0), 30 - F.col("n_empty") / n * 30)
        + F.coalesce(F.least(F.lit(30.0), ratio / 0.45 * 30), F.lit(0.0)),
    )
    missing = F.col("n_missing")
    return [
        F.when(n == 0, 100.0).otherwise(F.round(score, 1)).alias("score"),
        missing.alias("missing_count"),
        F.col("n_empty").alias("empty_count"),
        F.round(F.coalesce(ratio, F.lit(0.0)), 2).alias("avg_length_ratio"),
        _issues(
            F.when(
                missing > 0,
                F.concat(F.lit("有 "), missing.cast("string"), F.lit("/"), n.cast("string"),
                         F.lit(" 个段落缺失翻译")),
            ),
            _count_issue(("有 ", " 个段落译文为空"), F.col("n_empty")),
            F.when(
                (ratio < 0.5) | (ratio > 3.0),
                F.concat(F.lit("译文/原文长度比例异常: "), _number(ratio, 2)),
            ),
        ).alias("issues"),
    ]


def fidelity(counts: DataFrame) -> DataFrame:
    return counts.select("book_id", *_fidelity())


def _completeness() -> list[Column]:
    n, missing = F.col("n_source"), F.col("n_missing")
    return [
        F.when(n == 0, 100.0)
        .otherwise(F.round(F.col("n_translated") / n * 100, 1))
        .alias("score"),
        n.alias("source_paragraphs"),
        F.col("n_translated").alias("translated_paragraphs"),
        missing.alias("missing_count"),
        F.col("n_empty").alias("empty_paragraphs"),
        _issues(
            F.when(
                missing > 0,
                F.concat(F.lit("有 "), missing.cast("string"), F.lit(" 个段落未翻译（共 "),
                         n.cast("string"), F.lit(" 段）")),
            ),
            _count_issue(("有 ", " 个段落译文为空"), F.col("n_empty")),
        ).alias("issues"),
    ]


def completeness(counts: DataFrame) -> DataFrame:
    return counts.select("book_id", *_completeness())


# ---- target side: fluency, cultural adaptation, format -------------------------------


def target_counts(translated: DataFrame, script: str = P.CJK) -> DataFrame:
    """Per book, over the translated paragraphs joined by line feeds and stripped.

    Sums cover all paragraphs; white space at both ends of the joined text is taken off
    again: the leading part of the first and the trailing part of the last paragraph that
    is not blank, and whole blank paragraphs outside them (few, joined separately).
    """
    text = F.coalesce("translated", F.lit(""))
    blank = is_blank(text)
    spaces = F.lit(P.SPACE_CHARS)
    lead = F.left(text, F.length(text) - F.length(F.ltrim(text, spaces)))
    trail = F.right(text, F.length(text) - F.length(F.rtrim(text, spaces)))

    def weigh(piece: Column) -> Column:
        return F.struct(
            F.length(piece).cast("long").alias("chars"),
            F.regexp_count(piece, F.lit(script)).cast("long").alias("script"),
        )

    place = F.when(~blank, F.col("pos"))
    sums = translated.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("n_target"),
        F.count_if(text.rlike(P.LIST_ITEM)).alias("target_lists"),
        F.sum(F.length(text)).alias("chars"),
        F.sum(F.regexp_count(text, F.lit(script)).cast("long")).alias("script"),
        F.sum(F.regexp_count(text, F.lit(P.LATIN_WORD)).cast("long")).alias("words"),
        F.sum(F.regexp_count(text, F.lit(P.WESTERN_DATE)).cast("long")).alias("dates"),
        F.sum(F.regexp_count(text, F.lit(P.IMPERIAL)).cast("long")).alias("units"),
        F.sum(F.regexp_count(text, F.lit(P.CURRENCY)).cast("long")).alias("currency"),
        F.min(place).alias("first_pos"),
        F.max(place).alias("last_pos"),
        F.min_by(weigh(lead), place).alias("lead"),
        F.max_by(weigh(trail), place).alias("trail"),
    )
    edges = (
        translated.where(blank)
        .select("book_id", "pos", weigh(text).alias("w"))
        .join(sums.select("book_id", "first_pos", "last_pos"), "book_id")
        .where((F.col("pos") < F.col("first_pos")) | (F.col("pos") > F.col("last_pos")))
        .groupBy("book_id")
        .agg(F.sum(F.col("w.chars") + 1).alias("cut_chars"), F.sum("w.script").alias("cut_script"))
    )
    zero = F.lit(0)
    return sums.join(edges, "book_id", "left").select(
        "book_id", "n_target", "target_lists", "words", "dates", "units", "currency",
        F.col("first_pos").isNull().alias("all_blank"),
        (
            F.col("chars") + F.col("n_target") - 1
            - F.coalesce("lead.chars", zero) - F.coalesce("trail.chars", zero)
            - F.coalesce("cut_chars", zero)
        ).alias("total_chars"),
        (
            F.col("script") - F.coalesce("lead.script", zero)
            - F.coalesce("trail.script", zero) - F.coalesce("cut_script", zero)
        ).alias("script_chars"),
    )


def _fluency() -> list[Column]:
    total, script, words = F.col("total_chars"), F.col("script_chars"), F.col("words")
    ratio = F.when(F.col("all_blank"), 1.0).otherwise(F.try_divide(script, total))
    density = script / F.greatest(F.lit(1), total - words * 5)
    score = (
        F.least(F.lit(50.0), ratio * 50)
        + F.when(ratio > 0, F.least(F.lit(30.0), density * 30)).otherwise(0.0)
        + F.greatest(F.lit(0), 20 - words * 5)
    )
    live = ~F.col("all_blank")
    return [
        F.when(F.col("all_blank"), 100.0)
        .otherwise(F.round(F.least(F.lit(100.0), score), 1))
        .alias("score"),
        F.round(ratio, 4).alias("chinese_ratio"),
        F.when(live, words).otherwise(0).alias("english_word_count"),
        _issues(
            F.when(
                live & (ratio < 0.5),
                F.concat(F.lit("中文字符占比偏低: "), _number(ratio * 100, 1), F.lit("%")),
            ),
            F.when(live, _count_issue(("发现 ", " 个遗留英文词汇"), words)),
        ).alias("issues"),
    ]


def fluency(counts: DataFrame) -> DataFrame:
    return counts.select("book_id", *_fluency())


def _cultural() -> list[Column]:
    n = F.col("dates") + F.col("units") + F.col("currency")
    return [
        F.greatest(F.lit(0.0), 100.0 - n * 20).alias("score"),
        F.col("dates").alias("western_date_count"),
        F.col("units").alias("imperial_units"),
        F.col("currency").alias("western_currency"),
        _issues(
            _count_issue(("发现 ", " 处西式日期格式，建议改为中文格式"), F.col("dates")),
            _count_issue(("发现 ", " 处英制度量衡，建议适配公制单位"), F.col("units")),
            _count_issue(("发现 ", " 处西式货币符号"), F.col("currency")),
        ).alias("issues"),
    ]


def cultural(counts: DataFrame) -> DataFrame:
    return counts.select("book_id", *_cultural())


def _format() -> list[Column]:
    s, t, sl, tl = (
        F.coalesce(c, F.lit(0).cast("long"))
        for c in ("n_source", "n_target", "source_lists", "target_lists")
    )
    score = (
        F.when(s == t, 40.0).otherwise(0.0)
        + F.when(s > 0, F.least(s, t) / F.greatest(s, F.lit(1)) * 30).otherwise(0.0)
        + F.when((sl > 0) | (tl > 0), F.least(sl, tl) / F.greatest(sl, F.lit(1)) * 30)
        .otherwise(30.0)
    )

    def mismatch(text: str, a: Column, b: Column, unit: str) -> Column:
        return F.when(
            a != b,
            F.concat(F.lit(f"{text}: 原文 "), a.cast("string"), F.lit(f" {unit} ≠ 译文 "),
                     b.cast("string"), F.lit(f" {unit}")),
        )

    return [
        F.when((s == 0) & (t == 0), 100.0)
        .otherwise(F.round(F.least(F.lit(100.0), score), 1))
        .alias("score"),
        (s == t).alias("para_count_match"),
        s.alias("source_paragraphs"),
        t.alias("translated_paragraphs"),
        sl.alias("source_lists"),
        tl.alias("translated_lists"),
        _issues(
            mismatch("段落数不匹配", s, t, "段"), mismatch("列表项数不匹配", sl, tl, "个")
        ).alias("issues"),
    ]


def format_integrity(source: DataFrame, target: DataFrame) -> DataFrame:
    """From the counts of both sides; a book that lacks one side counts it as empty."""
    both = source.select("book_id", "n_source", "source_lists").join(
        target.select("book_id", "n_target", "target_lists"), "book_id", "full"
    )
    return both.select("book_id", *_format())


# ---- memory side: consistency, terminology -------------------------------------------


def term_variants(memory: DataFrame) -> DataFrame:
    """`(book_id, term, variant, first_pos)`: distinct translations of each source text."""
    term = F.lower(strip(F.coalesce("original", F.lit(""))))
    variant = strip(F.coalesce("translated", F.lit("")))
    return (
        memory.select("book_id", "pos", term.alias("term"), variant.alias("variant"))
        .where((F.length("term") > 0) & (F.length("variant") > 0))
        .groupBy("book_id", "term", "variant")
        .agg(F.min("pos").alias("first_pos"))
    )


def consistency(memory: DataFrame) -> DataFrame:
    """Share of source texts with one translation only; the issue names the first three."""
    terms = term_variants(memory).groupBy("book_id", "term").agg(
        F.count(F.lit(1)).alias("variants"), F.min("first_pos").alias("first_pos")
    )
    books = memory.select("book_id").distinct()
    counts = terms.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("total_terms"),
        F.count_if(F.col("variants") > 1).alias("inconsistent_terms"),
    )
    named = (
        first_rows(
            terms.where(F.col("variants") > 1), ["book_id"],
            [F.col("first_pos"), F.col("term")], 3,
        )
        .groupBy("book_id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "first_pos", "term",
                        F.concat(F.lit("'"), F.col("term"), F.lit("'→"),
                                 F.col("variants").cast("string"), F.lit(" 种译法")).alias("t"),
                    )
                )
            ).alias("first_terms")
        )
    )
    total, bad = F.col("total_terms"), F.col("inconsistent_terms")
    return (
        books.join(counts, "book_id", "left")
        .join(named, "book_id", "left")
        .fillna(0, ["total_terms", "inconsistent_terms"])
        .select(
            "book_id",
            F.when(total == 0, 100.0)
            .otherwise(F.round(F.greatest(F.lit(0.0), 100 - bad / total * 100), 1))
            .alias("score"),
            total.alias("total_terms"),
            bad.alias("inconsistent_terms"),
            _issues(
                F.when(
                    bad > 0,
                    F.concat(
                        F.lit("有 "), bad.cast("string"), F.lit(" 个术语翻译不一致: "),
                        F.array_join(F.col("first_terms.t"), ", "),
                    ),
                )
            ).alias("issues"),
        )
    )


def glossary(spark, terms: dict[str, str] = P.GLOSSARY) -> DataFrame:
    """The fixed term list (twelve rows), safe to broadcast."""
    return spark.createDataFrame(list(terms.items()), "term string, expected string")


def glossary_hits(memory: DataFrame, terms: DataFrame) -> DataFrame:
    """Memory entries whose source is a glossary term, with the verdict."""
    term = F.lower(strip(F.coalesce("original", F.lit(""))))
    said = F.lower(strip(F.coalesce("translated", F.lit(""))))
    expected = F.lower("expected")
    return (
        memory.select("book_id", "pos", term.alias("term"), said.alias("said"))
        .where(F.length("said") > 0)
        .join(terms, "term")
        .select(
            "book_id", "pos", "term", "said", "expected",
            (F.contains(F.col("said"), expected) | F.contains(expected, F.col("said"))).alias(
                "correct"
            ),
        )
    )


def terminology(memory: DataFrame, terms: DataFrame) -> DataFrame:
    hits = glossary_hits(memory, terms)
    counts = hits.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("total_terms"),
        F.count_if("correct").alias("matched_count"),
        F.count_if(~F.col("correct")).alias("incorrect_count"),
    )
    wrong = (
        first_rows(hits.where(~F.col("correct")), ["book_id"], [F.col("pos")], 3)
        .groupBy("book_id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "pos",
                        F.concat(F.lit("'"), F.col("term"), F.lit("'→'"), F.col("said"),
                                 F.lit("' (期望: '"), F.col("expected"), F.lit("')")).alias("t"),
                    )
                )
            ).alias("w")
        )
    )
    total, ok, bad = F.col("total_terms"), F.col("matched_count"), F.col("incorrect_count")
    return (
        memory.select("book_id").distinct()
        .join(counts, "book_id", "left")
        .join(wrong, "book_id", "left")
        .fillna(0, ["total_terms", "matched_count", "incorrect_count"])
        .select(
            "book_id",
            F.when(total == 0, 100.0).otherwise(F.round(ok / total * 100, 1)).alias("score"),
            total.alias("total_terms"),
            ok.alias("matched_count"),
            bad.alias("incorrect_count"),
            _issues(
                F.when(
                    bad > 0,
                    F.concat(
                        F.lit("有 "), bad.cast("string"), F.lit("/"), total.cast("string"),
                        F.lit(" 个术语翻译不准确: "), F.array_join(F.col("w.t"), "; "),
                    ),
                )
            ).alias("issues"),
        )
    )


# ---- table of contents ----------------------------------------------------------------


def toc_links(entries: DataFrame, editions: DataFrame) -> DataFrame:
    """Share of contents entries whose page exists, averaged over a book's editions.

    `editions` lists `(book_id, edition)`; an edition without entries scores 0.
    """
    valid = F.col("page").between(1, F.col("page_count"))
    per = entries.groupBy("book_id", "edition").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(valid, F.lit(False))).alias("ok")
    )
    scored = editions.join(per, ["book_id", "edition"], "left").fillna(0, ["n", "ok"])
    share = F.when(F.col("n") > 0, F.round(F.col("ok") / F.col("n") * 100, 1)).otherwise(0.0)
    return scored.groupBy("book_id").agg(
        F.round(F.avg(share), 4).alias("score"),
        F.sum("n").alias("toc_entries"),
        F.sum("ok").alias("valid_links"),
        F.sum(F.col("n") - F.col("ok")).alias("broken_links"),
    ).withColumn("issues", F.array().cast("array<string>"))


# ---- report ---------------------------------------------------------------------------


DETAILS = {
    "fidelity": ["missing_count", "empty_count", "avg_length_ratio"],
    "fluency": ["chinese_ratio", "english_word_count"],
    "consistency": ["total_terms", "inconsistent_terms"],
    "format": ["para_count_match", "source_paragraphs", "translated_paragraphs"],
    "terminology": ["matched_count", "incorrect_count"],
    "cultural": ["western_date_count", "imperial_units"],
    "completeness": [
        "source_paragraphs", "translated_paragraphs", "missing_count", "empty_paragraphs",
    ],
    "pdf_toc_links": ["toc_entries", "valid_links", "broken_links"],
}


def _scored(dimension: str, present: Column) -> Column:
    """One dimension of a book from its column of scores; null when it does not apply."""
    scores = F.col(f"_{dimension}")
    pairs = [x for d in DETAILS[dimension] for x in (F.lit(d), scores[d].cast("double"))]
    return F.when(
        present,
        F.struct(
            F.lit(dimension).alias("dimension"), scores["score"].alias("score"),
            scores["issues"].alias("issues"), F.create_map(*pairs).alias("details"),
        ),
    )


def dimensions(
    sources: DataFrame,
    translated: DataFrame,
    memory: DataFrame,
    toc: tuple[DataFrame, DataFrame] | None = None,
    script: str = P.CJK,
) -> DataFrame:
    """All dimension rows `(book_id, dimension, score, issues, details)`.

    Present dimensions only: the memory-based ones for books with memory entries, the
    target-based ones for books with translated paragraphs, contents where entries exist.
    Texts are read once per side: the counts of a book are put on one row, all its scores
    are worked out there, and the row is unfolded at the end.
    """
    spark = sources.sparkSession

    def packed(scores: DataFrame, name: str) -> DataFrame:
        columns = [c for c in scores.columns if c != "book_id"]
        return scores.select("book_id", F.struct(*columns).alias(f"_{name}"))

    wide = (
        source_counts(sources, memory)
        .join(target_counts(translated, script), "book_id", "full")
        .join(packed(consistency(memory), "consistency"), "book_id", "full")
        .join(packed(terminology(memory, glossary(spark)), "terminology"), "book_id", "full")
    )
    has_source, has_target = F.col("n_source").isNotNull(), F.col("n_target").isNotNull()
    present = {
        "fidelity": has_source,
        "fluency": has_target,
        "consistency": F.col("_consistency").isNotNull(),
        "format": has_source | has_target,
        "terminology": F.col("_terminology").isNotNull(),
        "cultural": has_target,
        "completeness": has_source,
    }
    if toc is not None:
        wide = wide.join(packed(toc_links(*toc), "pdf_toc_links"), "book_id", "full")
        present["pdf_toc_links"] = F.col("_pdf_toc_links").isNotNull()
    scored = wide.select(
        "*",
        F.struct(*_fidelity()).alias("_fidelity"),
        F.struct(*_fluency()).alias("_fluency"),
        F.struct(*_format()).alias("_format"),
        F.struct(*_cultural()).alias("_cultural"),
        F.struct(*_completeness()).alias("_completeness"),
    )
    rows = F.array_compact(F.array(*[_scored(name, test) for name, test in present.items()]))
    return scored.select("book_id", F.explode(rows).alias("d")).select("book_id", "d.*")


def grade(score: Column, limits: dict[str, float] = P.GRADE_LIMITS) -> Column:
    return (
        F.when(score >= limits["excellent"], P.GRADES["excellent"])
        .when(score >= limits["good"], P.GRADES["good"])
        .when(score >= limits["pass"], P.GRADES["pass"])
        .otherwise(P.GRADES["fail"])
    )


def overall(
    books: DataFrame, rows: DataFrame, limits: dict[str, float] = P.GRADE_LIMITS
) -> DataFrame:
    """Report per book: equal-weight mean, grade, summary and recommendation.

    One set of limits serves grade and summary. Books without any dimension get the
    cannot-assess report. A book has at most eight dimension rows, so its lists are short.
    """
    rank = F.array_position(F.array(*[F.lit(d) for d in DIMENSIONS]), F.col("dimension"))
    # Scores have four decimals at most. Their exact sum is the same in any order; a sum of
    # doubles falls to either side of a mean that ends in 5.
    total = F.sum(F.col("score").cast("decimal(20,4)"))
    per_book = rows.groupBy("book_id").agg(
        F.round(total / F.count(F.lit(1)), 1).cast("double").alias("overall_score"),
        F.count(F.lit(1)).alias("n_dimensions"),
        F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "issues"))).alias("_d"),
    )
    issues = F.coalesce(F.flatten(F.col("_d.issues")), F.array().cast("array<string>"))
    score, n = F.col("overall_score"), F.size("issues").cast("string")
    banded = (
        F.when(score >= limits["excellent"], F.lit("整体翻译质量优秀"))
        .when(score >= limits["good"],
              F.concat(F.lit("整体翻译质量良好，存在 "), n, F.lit(" 个可优化点")))
        .when(score >= limits["pass"],
              F.concat(F.lit("整体翻译质量合格，但有 "), n, F.lit(" 个需要关注的问题")))
        .otherwise(F.concat(F.lit("整体翻译质量需要改进，发现 "), n, F.lit(" 个问题")))
    )
    first = F.array_join(F.slice("issues", 1, 3), "；")
    advice = (
        F.when(score >= limits["excellent"], "可直接发布")
        .when(score >= limits["good"], "建议修复明显问题后发布")
        .when(score >= limits["pass"], "建议人工校对后发布")
        .otherwise("建议重新翻译或人工全面校对")
    )
    none = F.col("n_dimensions").isNull()
    return (
        books.select("book_id", "title")
        .join(per_book, "book_id", "left")
        .withColumn("issues", issues)
        .select(
            "book_id",
            "title",
            F.coalesce(score, F.lit(0.0)).alias("overall_score"),
            F.when(none, P.NO_GRADE).otherwise(grade(score, limits)).alias("overall_grade"),
            F.coalesce("n_dimensions", F.lit(0)).cast("long").alias("n_dimensions"),
            F.when(none, "质量检查无法完成: 无可用数据，无法完成质量评估")
            .when(F.size("issues") > 0, F.concat(banded, F.lit("："), first))
            .otherwise(banded)
            .alias("summary"),
            F.when(none, "请检查翻译数据完整性后重试").otherwise(advice).alias("recommendation"),
            F.when(F.size("issues") > 0, first).otherwise("无").alias("main_issues"),
        )
    )


def report_json(report: DataFrame, rows: DataFrame) -> DataFrame:
    """`(book_id, quality_report)`: the nested JSON text of each book's report."""

    def by_name(a: Column, b: Column) -> Column:
        return F.when(a.dimension < b.dimension, -1).when(a.dimension > b.dimension, 1).otherwise(0)

    entries = F.collect_list(
        F.struct("dimension", F.struct("score", "issues", "details").alias("r"))
    )
    nested = rows.groupBy("book_id").agg(
        F.map_from_entries(F.array_sort(entries, by_name)).alias("dimensions")
    )
    return report.join(nested, "book_id", "left").select(
        "book_id",
        F.to_json(
            F.struct(
                F.col("title").alias("book_title"), "overall_score", "overall_grade",
                "summary", "recommendation", "dimensions",
            )
        ).alias("quality_report"),
    )


REPORT_SCHEMA = """book_title string, overall_score double, overall_grade string,
summary string, recommendation string,
dimensions map<string, struct<score:double, issues:array<string>, details:map<string,double>>>"""


def read_report_json(reports: DataFrame) -> DataFrame:
    return reports.select(
        "book_id", F.from_json("quality_report", REPORT_SCHEMA).alias("r")
    ).select("book_id", "r.*")
