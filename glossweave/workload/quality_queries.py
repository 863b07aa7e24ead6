"""Translation memory, alignment, quality and the translation run over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.functions import patterns as P
from glossweave.functions.text import fold
from glossweave.operators import align, memory as tm, quality
from glossweave.operators.paragraphs import mark_repeats
from glossweave.plans.translate import run_stats as stats_of
from glossweave.plans.translate import translate_books as translate
from glossweave.sources import memory_files
from glossweave.workload.registry import query
from glossweave.workload.views import (
    Views, rx, s_count, s_fold, s_squeeze, s_stand_in, s_strip, s_tier, stand_in,
)


# ---- memory files ---------------------------------------------------------------------

_TS = "1700000000.0::DOUBLE + ((book_id * 7 + pos) % 60) * 86400.0::DOUBLE"
AS_OF = 1700000000.0 + 45 * 86400


def _memory_json(v: Views) -> DataFrame:
    """Each segment as a small memory file; some hold a second entry without an answer."""
    ts = F.lit(1700000000.0) + ((F.col("book_id") * 7 + F.col("pos")) % 60) * F.lit(86400.0)

    def entry(source: Column, translated: Column) -> Column:
        return F.struct(source.alias("source"), translated.alias("translated"), ts.alias("timestamp"))

    unanswered = F.concat(F.lit("Blank line "), F.col("pos").cast("string"))
    cache = F.map_concat(
        F.create_map(F.md5("original"), entry(F.col("original"), F.col("translated"))),
        F.when((F.col("book_id") * 7 + F.col("pos")) % 5 == 0, F.create_map(F.md5(unanswered), entry(unanswered, F.lit(""))))
        .otherwise(F.create_map().cast("map<string,struct<source:string,translated:string,timestamp:double>>")),
    )
    file = F.to_json(F.struct(cache.alias("cache")))
    return memory_files.parse_memory_json(v.segments.select(file.alias("value")), "value")


_ENTRIES = f"""e AS (SELECT md5(original) AS source_hash, original AS source_text,
    translated AS translated_text, {_TS} AS ts FROM segments
    UNION ALL SELECT md5('Blank line ' || pos), 'Blank line ' || pos, '', {_TS} FROM segments
    WHERE (book_id * 7 + pos) % 5 = 0)"""


@query(
    "tm_import",
    f"""WITH {_ENTRIES}, one AS (SELECT source_hash, min((source_text, translated_text)) AS m
            FROM e WHERE source_text <> '' AND translated_text <> '' GROUP BY source_hash)
        SELECT source_hash, m[1] AS source_text, m[2] AS translated_text FROM one
        WHERE source_hash NOT IN (SELECT source_hash FROM tm)""",
)
def tm_import(v: Views) -> DataFrame:
    """The books' own memory files go into the shared memory."""
    return memory_files.new_entries(_memory_json(v), v.tm)


@query(
    "tm_expire",
    f"""WITH {_ENTRIES} SELECT source_hash, source_text, ts FROM e
        WHERE {AS_OF}::DOUBLE - ts <= 2592000""",
)
def tm_expire(v: Views) -> DataFrame:
    return memory_files.not_expired(_memory_json(v), AS_OF).select(
        "source_hash", "source_text", "ts"
    )


# ---- memory joins ---------------------------------------------------------------------


@query(
    "tm_lookup",
    """SELECT n.book_id, n.pos, n.text, CASE WHEN trim(translated_text) <> '' THEN translated_text END
            AS translated, coalesce(trim(translated_text) <> '', false) AS hit
        FROM nodes n LEFT JOIN tm ON tm.source_text = n.text""",
)
def tm_lookup(v: Views) -> DataFrame:
    return tm.lookup(v.nodes, v.tm).select("book_id", "pos", "text", "translated", "hit")


@query(
    "tm_misses",
    """SELECT book_id, pos, text FROM nodes WHERE text NOT IN
        (SELECT source_text FROM tm WHERE trim(translated_text) <> '')""",
)
def tm_misses(v: Views) -> DataFrame:
    return tm.misses(v.nodes, v.tm).select("book_id", "pos", "text")


_MARKED = f"""tiered AS (SELECT book_id, pos, text, {s_tier('text')} AS tier FROM nodes),
    marked AS (SELECT *, CASE WHEN tier = 'tier1_short_repeatable'
        THEN min(pos) OVER (PARTITION BY book_id, tier, text) ELSE pos END AS first_pos FROM tiered)"""


@query(
    "dup_fanout",
    f"""WITH {_MARKED} SELECT m.book_id, m.pos, m.first_pos < m.pos AS is_duplicate,
            '译：' || o.text AS translated
        FROM marked m JOIN nodes o ON o.book_id = m.book_id AND o.pos = m.first_pos""",
)
def dup_fanout(v: Views) -> DataFrame:
    marked = mark_repeats(v.nodes, "book_id", "pos")
    ids = marked.select(
        "book_id", F.col("pos").alias("id"), "is_duplicate",
        F.when(F.col("is_duplicate"), F.col("first_pos")).alias("original_id"),
    )
    results = marked.where(~F.col("is_duplicate")).select(
        "book_id", F.col("pos").alias("id"), F.concat(F.lit("译："), "text").alias("translated")
    )
    return tm.fan_out(ids, results, ["book_id"]).select(
        "book_id", F.col("id").alias("pos"), "is_duplicate", "translated"
    )


@query(
    "all_segments",
    """SELECT n.book_id, n.pos, coalesce(CASE WHEN trim(translated_text) <> '' THEN translated_text END,
            '译：' || n.text) AS translated,
            coalesce(trim(translated_text) <> '', false) AS is_from_cache
        FROM nodes n LEFT JOIN tm ON tm.source_text = n.text""",
)
def all_segments(v: Views) -> DataFrame:
    """Cached and fresh results in one table; the fresh ones lack the cache flag."""
    cached = tm.lookup(v.nodes, v.tm).where("hit").select(
        "book_id", "pos", "translated", F.lit(True).alias("is_from_cache")
    )
    fresh = tm.misses(v.nodes, v.tm).select(
        "book_id", "pos", F.concat(F.lit("译："), "text").alias("translated")
    )
    return cached.unionByName(fresh, allowMissingColumns=True).fillna({"is_from_cache": False})


@query(
    "tm_upsert",
    f"""WITH u AS (SELECT md5(text) AS h, arg_max('译：' || text || CASE WHEN pos % 2 = 0 THEN '' ELSE '!' END,
                (book_id, pos)) AS t, min(text) AS s FROM nodes GROUP BY md5(text))
        SELECT coalesce(source_hash, h) AS source_hash, coalesce(source_text, s) AS source_text,
            coalesce(t, translated_text) AS translated_text,
            CASE WHEN h IS NULL THEN 'kept' WHEN source_hash IS NULL THEN 'inserted'
                ELSE 'updated' END AS change
        FROM (SELECT * FROM tm UNION ALL SELECT md5(title), title, title FROM
            (SELECT DISTINCT title FROM books) WHERE md5(title) NOT IN (SELECT source_hash FROM tm)) x
            FULL JOIN u ON u.h = x.source_hash""",
)
def tm_upsert(v: Views) -> DataFrame:
    titles = v.books.select("title").distinct().select(
        F.md5("title").alias("source_hash"), F.col("title").alias("source_text"),
        F.col("title").alias("translated_text"),
    )
    held = v.tm.unionByName(titles.join(v.tm.select("source_hash"), "source_hash", "left_anti"))
    updates = v.nodes.select(
        F.col("text").alias("source_text"),
        F.concat(F.lit("译："), "text", F.when(F.col("pos") % 2 == 0, "").otherwise("!"))
        .alias("translated_text"),
        F.struct("book_id", "pos").alias("seq"),
    )
    return tm.upsert(held, updates, "seq")


_RUN = f"""{_MARKED},
    looked AS (SELECT m.*, first_pos < pos AS is_duplicate,
        first_pos = pos AND coalesce(trim(translated_text) <> '', false) AS hit
        FROM marked m LEFT JOIN tm ON tm.source_text = m.text)"""


@query(
    "run_stats",
    f"""WITH {_RUN} SELECT language, count(*) AS paragraphs, count(*) FILTER (hit) AS cache_hits,
            round(count(*) FILTER (hit) * 100.0::DOUBLE / count(*), 1) AS hit_pct,
            count(*) FILTER (NOT hit AND NOT is_duplicate) AS translated,
            count(*) FILTER (is_duplicate) AS repeats,
            CAST(0 AS BIGINT) AS retried, CAST(0 AS BIGINT) AS failed,
            count(*) FILTER (tier = 'tier1_short_repeatable') AS tier1,
            count(*) FILTER (tier = 'tier2_normal') AS tier2,
            count(*) FILTER (tier = 'tier3_long_complex') AS tier3
        FROM looked JOIN books USING (book_id) GROUP BY language""",
)
def run_stats(v: Views) -> DataFrame:
    """Flagship: documents to paragraphs, tiers, repeats, memory hits, counts per language."""
    nodes = v.nodes.join(v.books.select("book_id", "language"), "book_id")
    marked = mark_repeats(nodes, "book_id", "pos")
    looked = tm.lookup(marked, v.tm)
    run = looked.select(
        "language", "tier",
        F.when(F.col("is_duplicate"), "repeat").when(F.col("hit"), "memory").otherwise("model")
        .alias("origin"),
        F.lit("ok").alias("action"), F.lit(False).alias("failed"), F.lit(0).alias("calls"),
    )
    # No model runs here, so there are no calls to count.
    return stats_of(run, ["language"]).drop("api_calls")


def stub_model(prompt: str) -> str:
    """A deterministic stand-in for a model: marks each numbered item, or the whole text."""
    if prompt.startswith("[1] "):
        return "\n\n".join(
            part.replace("] ", "] 译：", 1) for part in prompt.split("\n\n")
        )
    return "译：" + prompt


@query(
    "translate_books",
    f"""WITH {_RUN} SELECT l.book_id, l.pos, l.tier,
            CASE WHEN l.is_duplicate THEN 'repeat' WHEN l.hit THEN 'memory' ELSE 'model' END AS origin,
            CASE WHEN o.hit THEN {s_stand_in('l.text')} ELSE '译：' || l.text END AS translated
        FROM looked l JOIN looked o ON o.book_id = l.book_id AND o.pos = l.first_pos""",
)
def translate_books(v: Views) -> DataFrame:
    return translate(v.nodes.select("book_id", "pos", "text"), v.tm, stub_model).segments.select(
        "book_id", "pos", "tier", "origin", "translated"
    )


@query(
    "translate_memory",
    f"""WITH {_RUN},
        new AS (SELECT DISTINCT text FROM looked WHERE NOT hit AND NOT is_duplicate)
        SELECT coalesce(t.source_hash, md5(n.text)) AS source_hash,
            coalesce(t.source_text, n.text) AS source_text,
            CASE WHEN n.text IS NULL THEN t.translated_text ELSE '译：' || n.text END AS translated_text,
            CASE WHEN n.text IS NULL THEN 'kept' WHEN t.source_hash IS NULL THEN 'inserted' ELSE 'updated' END AS change
        FROM tm t FULL JOIN new n ON n.text = t.source_text""",
)
def translate_memory(v: Views) -> DataFrame:
    """The memory after a run: what was held, with what the model was asked for."""
    return translate(v.nodes.select("book_id", "pos", "text"), v.tm, stub_model).memory


def faulty_model(prompt: str) -> str:
    """As `stub_model`, but a prompt with this letter fails; a batch then goes one by one."""
    if "W" in prompt:
        raise ValueError("refused")
    return stub_model(prompt)


@query(
    "translate_failed",
    f"""WITH {_RUN} SELECT l.book_id, l.pos, l.text AS original, o.text AS translated,
            CASE WHEN NOT l.is_duplicate THEN 'ValueError: refused' END AS error
        FROM looked l JOIN looked o ON o.book_id = l.book_id AND o.pos = l.first_pos
        WHERE NOT o.hit AND contains(o.text, 'W')
            AND EXISTS (SELECT 1 FROM looked f WHERE f.book_id = l.book_id AND NOT f.hit
                AND NOT f.is_duplicate AND NOT contains(f.text, 'W'))""",
)
def translate_failed(v: Views) -> DataFrame:
    """Paragraphs that kept their original because every call for them failed."""
    run = translate(v.nodes.select("book_id", "pos", "text"), v.tm, faulty_model)
    return run.segments.where("failed").select("book_id", "pos", "original", "translated", "error")


@query(
    "translation_stats",
    f"""WITH RECURSIVE {_RUN},
        todo AS (SELECT book_id, tier, pos, length(text) AS n,
            row_number() OVER (PARTITION BY book_id, tier ORDER BY pos) AS rn
            FROM looked WHERE NOT hit AND NOT is_duplicate),
        walk AS (SELECT book_id, tier, rn, n AS fill, 1 AS opens FROM todo
            WHERE rn = 1 AND tier <> 'tier3_long_complex'
            UNION ALL
            SELECT t.book_id, t.tier, t.rn, CASE WHEN w.fill + t.n > 1800 THEN t.n ELSE w.fill + t.n END,
                CASE WHEN w.fill + t.n > 1800 THEN 1 ELSE 0 END
            FROM walk w JOIN todo t ON t.book_id = w.book_id AND t.tier = w.tier AND t.rn = w.rn + 1),
        calls AS (SELECT tier, sum(opens) AS n FROM walk GROUP BY tier
            UNION ALL SELECT tier, count(*) FROM todo WHERE tier = 'tier3_long_complex' GROUP BY tier)
        SELECT l.tier, count(*) AS paragraphs, count(*) FILTER (hit) AS cache_hits,
            count(*) FILTER (is_duplicate) AS repeats,
            count(*) FILTER (NOT hit AND NOT is_duplicate) AS translated,
            CAST(max(coalesce(c.n, 0)) AS BIGINT) AS api_calls
        FROM looked l LEFT JOIN calls c USING (tier) GROUP BY l.tier""",
)
def translation_stats(v: Views) -> DataFrame:
    run = translate(v.nodes.select("book_id", "pos", "text"), v.tm, stub_model)
    return stats_of(run.segments, ["tier"]).select(
        "tier", "paragraphs", "cache_hits", "repeats", "translated", "api_calls"
    )


# ---- alignment ------------------------------------------------------------------------

_SIG = "regexp_replace(lower(substr({x}, 1, 200)), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def _sig(x: str) -> str:
    return _SIG.format(x=x)


_LABELS = ", ".join(f"('{en}', '{zh}', {n})" for n, (en, zh) in enumerate(P.ADMONITIONS.items()))
_MAP = f"""raw AS (SELECT *, {s_fold('original')} AS key FROM tm_segments
        WHERE original <> '' AND translated <> ''),
    own AS (SELECT book_id, key, min(pos) AS first_pos, arg_max(original, pos) AS original,
        arg_max(translated, pos) AS translated FROM raw GROUP BY book_id, key),
    seeds AS (SELECT b.book_id, l.en AS key, 1099511627776 + n AS first_pos, l.en AS original, l.zh AS translated
        FROM (SELECT DISTINCT book_id FROM tm_segments) b, (VALUES {_LABELS}) l(en, zh, n)),
    tmap AS (SELECT * FROM own UNION ALL SELECT s.* FROM seeds s WHERE NOT EXISTS
        (SELECT 1 FROM own o WHERE o.book_id = s.book_id AND o.key = s.key)),
    loose AS (SELECT *, replace(key, ' ', '') AS ns,
        replace({s_strip(f"regexp_replace(key, '(?i){rx(P.LEADING_LABEL)}', '')")}, ' ', '') AS nl FROM tmap)"""


def _aligned(asked: str, long_keys: bool = True) -> str:
    gate = "length(q.text) > 50" if long_keys else "false"
    return f"""q AS (SELECT book_id, pos, text, {s_fold('text')} AS f, replace({s_fold('text')}, ' ', '') AS ns
        FROM {asked} WHERE length({s_fold('text')}) > 1),
    by_prefix AS (SELECT book_id, substr(key, 1, 80) AS k, arg_min(translated, first_pos) AS t FROM loose GROUP BY 1, 2),
    by_sig AS (SELECT book_id, {_sig('original')} AS k, arg_max(translated, first_pos) AS t FROM loose
        WHERE length(original) > 50 GROUP BY 1, 2),
    by_ns AS (SELECT book_id, ns AS k, arg_min(translated, first_pos) AS t FROM loose GROUP BY 1, 2),
    by_nl AS (SELECT book_id, nl AS k, arg_min(translated, first_pos) AS t FROM loose GROUP BY 1, 2),
    aligned AS (SELECT q.book_id, q.pos, q.text,
        coalesce(e.translated, p.t, s.t, n.t, l.t) AS translated,
        CASE WHEN e.translated IS NOT NULL THEN 'exact' WHEN p.t IS NOT NULL THEN 'prefix'
            WHEN s.t IS NOT NULL THEN 'signature' WHEN n.t IS NOT NULL THEN 'no_space'
            WHEN l.t IS NOT NULL THEN 'no_label' ELSE 'none' END AS align_method
        FROM q LEFT JOIN tmap e ON e.book_id = q.book_id AND e.key = q.f
        LEFT JOIN by_prefix p ON p.book_id = q.book_id AND p.k = substr(q.f, 1, 80) AND {gate}
        LEFT JOIN by_sig s ON s.book_id = q.book_id AND s.k = {_sig('q.text')} AND {gate}
        LEFT JOIN by_ns n ON n.book_id = q.book_id AND n.k = q.ns
        LEFT JOIN by_nl l ON l.book_id = q.book_id AND l.k = q.ns)"""


def _align(v: Views) -> DataFrame:
    return align.cascade(v.asked, v.tm_segments)


@query("label_seed", f"WITH {_MAP} SELECT book_id, key, translated FROM tmap")
def label_seed(v: Views) -> DataFrame:
    return align.translation_map(v.tm_segments).select("book_id", "key", "translated")


@query(
    "align_cascade",
    f"WITH {_MAP}, {_aligned('asked')} SELECT book_id, pos, translated, align_method FROM aligned",
)
def align_cascade(v: Views) -> DataFrame:
    return _align(v).select("book_id", "pos", "translated", "align_method")


@query(
    "align_rate",
    f"""WITH {_MAP}, {_aligned('asked')}, bad AS (SELECT book_id, string_agg(substr(text, 1, 100), '|' ORDER BY pos) AS samples
            FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY pos) AS rn FROM aligned
                WHERE align_method = 'none') WHERE rn <= 10 GROUP BY book_id)
        SELECT a.book_id, count(*) AS checked, count(*) FILTER (align_method <> 'none') AS matched,
            count(*) FILTER (align_method = 'none') AS unmatched,
            round(count(*) FILTER (align_method <> 'none') * 100.0::DOUBLE / count(*), 1) AS match_pct,
            coalesce(max(bad.samples), '') AS samples
        FROM aligned a LEFT JOIN bad USING (book_id) GROUP BY a.book_id""",
)
def align_rate(v: Views) -> DataFrame:
    rate = align.match_rate(_align(v))
    return rate.withColumn("samples", F.array_join("samples", "|"))


@query(
    "bilingual_edition",
    f"""WITH {_MAP}, {_aligned('asked')} SELECT book_id, pos,
        text || coalesce(chr(10) || translated, '') AS bilingual_text,
        coalesce(translated, text) AS target_text FROM aligned""",
)
def bilingual_edition(v: Views) -> DataFrame:
    return align.editions(_align(v))


# Every whole line is an entry of the contents, as are the chapter headings beside them.
_HEADS = "(SELECT book_id, pos, text FROM nodes WHERE tag <> 'figcaption') heads"


@query(
    "toc_translate",
    f"""WITH {_MAP}, {_aligned(_HEADS, long_keys=False)} SELECT book_id, pos,
        text || coalesce(' / ' || translated, '') AS bilingual_label,
        coalesce(translated, text) AS target_label FROM aligned""",
)
def toc_translate(v: Views) -> DataFrame:
    heads = v.nodes.where(F.col("tag") != "figcaption").select("book_id", "pos", "text")
    return align.translate_labels(align.cascade(heads, v.tm_segments, long_keys=False))


# ---- quality --------------------------------------------------------------------------


def _dec(x: str, digits: int) -> str:
    return f"CAST(CAST(round({x}, {digits}) AS DECIMAL(20, {digits})) AS VARCHAR)"


def _list(*items: str) -> str:
    return (
        "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"
    )


_SRC = f"""first_entry AS (SELECT book_id, {s_strip('original')} AS k,
        arg_min({s_strip("coalesce(translated, '')")}, pos) AS target FROM memory GROUP BY 1, 2),
    paired AS (SELECT s.book_id, s.pos, s.text, f.target FROM sources s
        LEFT JOIN first_entry f ON f.book_id = s.book_id AND f.k = {s_strip('s.text')}),
    src AS (SELECT book_id, count(*) AS n, count(*) FILTER (regexp_matches(text, '{rx(P.LIST_ITEM)}')) AS lists,
        count(*) FILTER (target <> '') AS ok, count(*) FILTER (target = '') AS empty,
        count(*) FILTER (target IS NULL) AS missing,
        avg(least(length(target) / length(text), 3.0::DOUBLE)) FILTER (target <> '') AS ratio
        FROM paired GROUP BY book_id),
    fidelity AS (SELECT book_id, round(least(100.0::DOUBLE, ok / n * 40 + greatest(0.0::DOUBLE, 30 - empty / n * 30)
            + coalesce(least(30.0::DOUBLE, ratio / 0.45::DOUBLE * 30), 0)), 1) AS score,
        missing AS missing_count, empty AS empty_count, round(coalesce(ratio, 0), 2) AS avg_length_ratio,
        {_list("CASE WHEN missing > 0 THEN '有 ' || missing || '/' || n || ' 个段落缺失翻译' END",
               "CASE WHEN empty > 0 THEN '有 ' || empty || ' 个段落译文为空' END",
               f"CASE WHEN ratio < 0.5 OR ratio > 3 THEN '译文/原文长度比例异常: ' || {_dec('ratio', 2)} END")} AS issues
        FROM src),
    completeness AS (SELECT book_id, round(ok / n * 100, 1) AS score, n AS source_paragraphs,
        ok AS translated_paragraphs, missing AS missing_count, empty AS empty_paragraphs,
        {_list("CASE WHEN missing > 0 THEN '有 ' || missing || ' 个段落未翻译（共 ' || n || ' 段）' END",
               "CASE WHEN empty > 0 THEN '有 ' || empty || ' 个段落译文为空' END")} AS issues FROM src)"""

_WORDS = (
    f"len(list_filter(regexp_split_to_array({{x}}, '[^\\p{{{{L}}}}\\p{{{{N}}}}_]+'), lambda w: "
    "regexp_full_match(w, '[a-zA-Z]{{2,}}') AND NOT starts_with(w, 'http') AND NOT starts_with(w, 'www')))"
)
_TGT = f"""whole AS (SELECT book_id, count(*) AS n,
        count(*) FILTER (regexp_matches(translated, '{rx(P.LIST_ITEM)}')) AS lists,
        {s_strip("string_agg(translated, chr(10) ORDER BY pos)")} AS t FROM targets GROUP BY book_id),
    tgt AS (SELECT *, length(t) AS total, {s_count('t', P.CJK)} AS script, {_WORDS.format(x='t')} AS words,
        {s_count('t', P.WESTERN_DATE)} AS dates, {s_count('t', r'(?i)[0-9]+ *inches')} AS units,
        {s_count('t', '[$€£¥]')} AS currency FROM whole),
    fl AS (SELECT *, CASE WHEN t = '' THEN 1.0::DOUBLE ELSE script / total END AS ratio FROM tgt),
    fluency AS (SELECT book_id, CASE WHEN t = '' THEN 100.0::DOUBLE ELSE round(least(100.0::DOUBLE,
            least(50.0::DOUBLE, ratio * 50) + CASE WHEN ratio > 0 THEN
                least(30.0::DOUBLE, script / greatest(1, total - words * 5) * 30) ELSE 0 END
            + greatest(0, 20 - words * 5)), 1) END AS score,
        round(ratio, 4) AS chinese_ratio, CASE WHEN t = '' THEN 0 ELSE words END AS english_word_count,
        {_list(f"CASE WHEN t <> '' AND ratio < 0.5 THEN '中文字符占比偏低: ' || {_dec('ratio * 100', 1)} || '%' END",
               "CASE WHEN t <> '' AND words > 0 THEN '发现 ' || words || ' 个遗留英文词汇' END")} AS issues FROM fl),
    cultural AS (SELECT book_id, greatest(0.0::DOUBLE, 100.0::DOUBLE - (dates + units + currency) * 20) AS score,
        dates AS western_date_count, units AS imperial_units, currency AS western_currency,
        {_list("CASE WHEN dates > 0 THEN '发现 ' || dates || ' 处西式日期格式，建议改为中文格式' END",
               "CASE WHEN units > 0 THEN '发现 ' || units || ' 处英制度量衡，建议适配公制单位' END",
               "CASE WHEN currency > 0 THEN '发现 ' || currency || ' 处西式货币符号' END")} AS issues FROM tgt)"""

_FMT = f"""fm AS (SELECT coalesce(s.book_id, w.book_id) AS book_id, coalesce(s.n, 0) AS s, coalesce(w.n, 0) AS t,
        coalesce(s.lists, 0) AS sl, coalesce(w.lists, 0) AS tl FROM src s FULL JOIN whole w ON w.book_id = s.book_id),
    format AS (SELECT book_id, round(least(100.0::DOUBLE, CASE WHEN s = t THEN 40 ELSE 0 END
            + CASE WHEN s > 0 THEN least(s, t) / greatest(s, 1) * 30 ELSE 0 END
            + CASE WHEN sl > 0 OR tl > 0 THEN least(sl, tl) / greatest(sl, 1) * 30 ELSE 30 END), 1) AS score,
        s = t AS para_count_match, s AS source_paragraphs, t AS translated_paragraphs,
        sl AS source_lists, tl AS translated_lists,
        {_list("CASE WHEN s <> t THEN '段落数不匹配: 原文 ' || s || ' 段 ≠ 译文 ' || t || ' 段' END",
               "CASE WHEN sl <> tl THEN '列表项数不匹配: 原文 ' || sl || ' 个 ≠ 译文 ' || tl || ' 个' END")} AS issues FROM fm)"""

_TERMS = ", ".join(f"('{a}', '{b}')" for a, b in P.GLOSSARY.items())
_MEM = f"""entries AS (SELECT book_id, pos, lower({s_strip('original')}) AS term, {s_strip('translated')} AS said FROM memory),
    terms AS (SELECT book_id, term, count(DISTINCT said) AS variants, min(pos) AS first_pos FROM entries
        WHERE term <> '' AND said <> '' GROUP BY 1, 2),
    three AS (SELECT book_id, string_agg('''' || term || '''→' || variants || ' 种译法', ', ' ORDER BY first_pos, term) AS s
        FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY first_pos, term) AS rn FROM terms
            WHERE variants > 1) WHERE rn <= 3 GROUP BY 1),
    tc AS (SELECT book_id, count(*) AS total, count(*) FILTER (variants > 1) AS bad FROM terms GROUP BY 1),
    consistency AS (SELECT b.book_id, CASE WHEN tc.total IS NULL THEN 100.0::DOUBLE
            ELSE round(greatest(0.0::DOUBLE, 100 - bad / total * 100), 1) END AS score,
        coalesce(total, 0) AS total_terms, coalesce(bad, 0) AS inconsistent_terms,
        {_list("CASE WHEN bad > 0 THEN '有 ' || bad || ' 个术语翻译不一致: ' || three.s END")} AS issues
        FROM (SELECT DISTINCT book_id FROM memory) b LEFT JOIN tc USING (book_id) LEFT JOIN three USING (book_id)),
    hits AS (SELECT book_id, pos, e.term, lower(said) AS said, expected,
        contains(lower(said), lower(expected)) OR contains(lower(expected), lower(said)) AS correct
        FROM entries e JOIN (VALUES {_TERMS}) g(term, expected) ON g.term = e.term WHERE said <> ''),
    wrong AS (SELECT book_id, string_agg('''' || term || '''→''' || said || ''' (期望: ''' || expected || ''')', '; ' ORDER BY pos) AS s
        FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY pos) AS rn FROM hits WHERE NOT correct)
        WHERE rn <= 3 GROUP BY 1),
    gc AS (SELECT book_id, count(*) AS total, count(*) FILTER (correct) AS ok, count(*) FILTER (NOT correct) AS bad
        FROM hits GROUP BY 1),
    terminology AS (SELECT b.book_id, CASE WHEN gc.total IS NULL THEN 100.0::DOUBLE
            ELSE round(ok / total * 100, 1) END AS score,
        coalesce(total, 0) AS total_terms, coalesce(ok, 0) AS matched_count, coalesce(bad, 0) AS incorrect_count,
        {_list("CASE WHEN bad > 0 THEN '有 ' || bad || '/' || total || ' 个术语翻译不准确: ' || wrong.s END")} AS issues
        FROM (SELECT DISTINCT book_id FROM memory) b LEFT JOIN gc USING (book_id) LEFT JOIN wrong USING (book_id))"""

_TOC = """toc_rows AS (SELECT book_id, pos, CASE WHEN pos % 2 = 0 THEN '双语' ELSE '中文' END AS edition,
        (pos * 7) % 50 AS page, 40 AS page_count FROM {x}),
    toc_books AS (SELECT DISTINCT book_id, unnest(['双语', '中文']) AS edition FROM {x}),
    toc_per AS (SELECT book_id, edition, count(*) AS n, count(*) FILTER (page BETWEEN 1 AND page_count) AS ok
        FROM toc_rows GROUP BY 1, 2),
    toc_links AS (SELECT b.book_id, round(avg(CASE WHEN n > 0 THEN round(ok / n * 100, 1) ELSE 0 END), 4) AS score,
        CAST(coalesce(sum(n), 0) AS BIGINT) AS toc_entries, CAST(coalesce(sum(ok), 0) AS BIGINT) AS valid_links,
        CAST(coalesce(sum(n - ok), 0) AS BIGINT) AS broken_links
        FROM toc_books b LEFT JOIN toc_per p USING (book_id, edition) GROUP BY 1)"""


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("issues", F.array_join("issues", "|"))


def _sql_flat(table: str) -> str:
    return f"SELECT * REPLACE (array_to_string(issues, '|') AS issues) FROM {table}"


@query("q_fidelity", f"WITH {_SRC} {_sql_flat('fidelity')}")
def q_fidelity(v: Views) -> DataFrame:
    return _flat(quality.fidelity(quality.source_counts(v.sources, v.memory)))


@query("q_completeness", f"WITH {_SRC} {_sql_flat('completeness')}")
def q_completeness(v: Views) -> DataFrame:
    return _flat(quality.completeness(quality.source_counts(v.sources, v.memory)))


@query("q_fluency", f"WITH {_TGT} {_sql_flat('fluency')}")
def q_fluency(v: Views) -> DataFrame:
    return _flat(quality.fluency(quality.target_counts(v.targets)))


@query("q_cultural", f"WITH {_TGT} {_sql_flat('cultural')}")
def q_cultural(v: Views) -> DataFrame:
    return _flat(quality.cultural(quality.target_counts(v.targets)))


@query("q_format", f"WITH {_SRC}, {_TGT}, {_FMT} {_sql_flat('format')}")
def q_format(v: Views) -> DataFrame:
    return _flat(
        quality.format_integrity(
            quality.source_counts(v.sources, v.memory), quality.target_counts(v.targets)
        )
    )


@query("q_consistency", f"WITH {_MEM} {_sql_flat('consistency')}")
def q_consistency(v: Views) -> DataFrame:
    return _flat(quality.consistency(v.memory))


@query(
    "q_term_variants",
    f"""SELECT book_id, lower({s_strip('original')}) AS term, {s_strip('translated')} AS variant,
        min(pos) AS first_pos FROM memory WHERE {s_strip('original')} <> '' AND {s_strip('translated')} <> ''
        GROUP BY ALL""",
)
def q_term_variants(v: Views) -> DataFrame:
    return quality.term_variants(v.memory)


@query("glossary_hits", f"WITH {_MEM} SELECT * FROM hits")
def glossary_hits(v: Views) -> DataFrame:
    return quality.glossary_hits(v.memory, quality.glossary(v.spark))


@query("q_terminology", f"WITH {_MEM} {_sql_flat('terminology')}")
def q_terminology(v: Views) -> DataFrame:
    return _flat(quality.terminology(v.memory, quality.glossary(v.spark)))


def _toc(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    editions = F.array(F.lit("双语"), F.lit("中文"))
    entries = rows.select(
        "book_id", "pos", F.when(F.col("pos") % 2 == 0, "双语").otherwise("中文").alias("edition"),
        (F.col("pos") * 7 % 50).alias("page"), F.lit(40).alias("page_count"),
    )
    books = rows.select("book_id").distinct().select("book_id", F.explode(editions).alias("edition"))
    return entries, books


@query("q_toc_links", f"WITH {_TOC.format(x='paragraphs')} SELECT * FROM toc_links")
def q_toc_links(v: Views) -> DataFrame:
    return quality.toc_links(*_toc(v.paragraphs)).drop("issues")


_REPORT = f"""{_SRC}, {_TGT}, {_FMT}, {_MEM}, {_TOC.format(x='segments')},
    dims AS (SELECT book_id, 1 AS rank, score, issues FROM fidelity
        UNION ALL SELECT book_id, 2, score, issues FROM fluency
        UNION ALL SELECT book_id, 3, score, issues FROM consistency
        UNION ALL SELECT book_id, 4, score, issues FROM format
        UNION ALL SELECT book_id, 5, score, issues FROM terminology
        UNION ALL SELECT book_id, 6, score, issues FROM cultural
        UNION ALL SELECT book_id, 7, score, issues FROM completeness
        UNION ALL SELECT book_id, 8, score, [] FROM toc_links),
    per AS (SELECT book_id, round(avg(score), 1) AS score, count(*) AS n,
        flatten(list(issues ORDER BY rank)) AS issues FROM dims GROUP BY book_id),
    texts AS (SELECT b.book_id, b.title, p.score, coalesce(n, 0) AS n, p.issues, len(p.issues) AS k,
        array_to_string(p.issues[1:3], '；') AS three FROM books b LEFT JOIN per p USING (book_id)),
    report AS (SELECT book_id, title, coalesce(score, 0.0::DOUBLE) AS overall_score,
        CASE WHEN score IS NULL THEN '无法评估' WHEN score >= 90 THEN '优秀' WHEN score >= 75 THEN '良好'
            WHEN score >= 60 THEN '合格' ELSE '需改进' END AS overall_grade, n AS n_dimensions,
        CASE WHEN score IS NULL THEN '质量检查无法完成: 无可用数据，无法完成质量评估' ELSE
            CASE WHEN score >= 90 THEN '整体翻译质量优秀'
                WHEN score >= 75 THEN '整体翻译质量良好，存在 ' || k || ' 个可优化点'
                WHEN score >= 60 THEN '整体翻译质量合格，但有 ' || k || ' 个需要关注的问题'
                ELSE '整体翻译质量需要改进，发现 ' || k || ' 个问题' END
            || CASE WHEN k > 0 THEN '：' || three ELSE '' END END AS summary,
        CASE WHEN score IS NULL THEN '请检查翻译数据完整性后重试' WHEN score >= 90 THEN '可直接发布'
            WHEN score >= 75 THEN '建议修复明显问题后发布' WHEN score >= 60 THEN '建议人工校对后发布'
            ELSE '建议重新翻译或人工全面校对' END AS recommendation,
        CASE WHEN k > 0 THEN three ELSE '无' END AS main_issues FROM texts)"""


def _dimensions(v: Views) -> DataFrame:
    return quality.dimensions(v.sources, v.targets, v.memory, _toc(v.segments))


def _report(v: Views) -> DataFrame:
    return quality.overall(v.books, _dimensions(v))


@query(
    "q_dimensions",
    f"""WITH {_REPORT} SELECT book_id, ['fidelity', 'fluency', 'consistency', 'format', 'terminology',
        'cultural', 'completeness', 'pdf_toc_links'][rank] AS dimension, score,
        array_to_string(issues, '|') AS issues FROM dims""",
)
def q_dimensions(v: Views) -> DataFrame:
    return _flat(_dimensions(v)).drop("details")


@query(
    "q_overall",
    f"WITH {_REPORT} SELECT book_id, overall_score, overall_grade, n_dimensions FROM report",
)
def q_overall(v: Views) -> DataFrame:
    return _report(v).select("book_id", "overall_score", "overall_grade", "n_dimensions")


@query("q_summary", f"WITH {_REPORT} SELECT book_id, summary, recommendation FROM report")
def q_summary(v: Views) -> DataFrame:
    return _report(v).select("book_id", "summary", "recommendation")


@query(
    "quality_digest",
    f"""WITH {_REPORT} SELECT title, book_id, overall_score, overall_grade, main_issues FROM report""",
)
def quality_digest(v: Views) -> DataFrame:
    return _report(v).select("book_id", "title", "overall_score", "overall_grade", "main_issues")


@query("quality_report_json")
def quality_report_json(v: Views) -> DataFrame:
    rows = _dimensions(v)
    return quality.report_json(quality.overall(v.books, rows), rows)
