"""Pages, paragraphs, batches and chapters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.functions import patterns as P
from glossweave.functions.text import tier
from glossweave.operators import batching, chapters as ch, paragraphs as pg
from glossweave.plans.scan import first_rows
from glossweave.workload.registry import query
from glossweave.workload.views import Views, W, s_strip, s_tier



@query("content_items", "SELECT page_id, item_id, html FROM content_items")
def content_items(v: Views) -> DataFrame:
    return v.content_items


_SEEN = ", ".join(f"'{t}'" for t in [*P.CONTENT_TAGS, *P.EXCLUDED_TAGS, "title"])
_DROPPED = ", ".join(f"'{t}'" for t in P.EXCLUDED_TAGS)


@query(
    "boilerplate_filter",
    rf"""WITH t AS (SELECT page_id, unnest([{_SEEN}]) AS tag, html FROM pages),
        n AS (SELECT page_id, tag,
            (length(html) - length(replace(html, '<' || tag || '>', ''))) // (length(tag) + 2)
            + (length(html) - length(replace(html, '<' || tag || ' ', ''))) // (length(tag) + 2)
                AS n_elements FROM t)
        SELECT page_id, tag, n_elements,
            CASE WHEN tag IN ({_DROPPED}) THEN n_elements ELSE 0 END AS n_excluded
        FROM n WHERE n_elements > 0""",
)
def boilerplate_filter(v: Views) -> DataFrame:
    return pg.elements(v.page_elements, ["page_id"]).groupBy("page_id", "tag").agg(
        F.count(F.lit(1)).alias("n_elements"), F.count_if("excluded").alias("n_excluded")
    )


def _pieces(x: str) -> str:
    """Text of an element as its stripped pieces put together, entities resolved."""
    joined = (
        f"array_to_string(list_transform(regexp_split_to_array({x}, '<[^>]*>'), "
        f"lambda s: {s_strip('s')}), '')"
    )
    return f"replace(replace({joined}, '&quot;', '\"'), '&amp;', '&')"


# The pages' paragraphs, read by their known layout: p and h1 without nested blocks, one
# div, list items that hold one link each.
_PAGE_SQL = rf"""
    WITH ps AS (SELECT page_id, item_id, 'p' AS tag, 1 AS rank,
            generate_subscripts(string_split(html, '<p>'), 1) AS nth,
            unnest(string_split(html, '<p>')) AS part FROM content_items),
    p AS (SELECT page_id, item_id, tag, rank, nth, {_pieces("regexp_replace(regexp_replace(part, '(?s)</p>.*', ''), '(?s)</article>.*', '')")} AS text FROM ps WHERE nth > 1),
    d AS (SELECT page_id, item_id, 'div' AS tag, 2 AS rank, 1 AS nth,
            {_pieces("regexp_extract(html, '(?s)<div[^>]*>(.*?)</div>', 1)")} AS text FROM content_items),
    h AS (SELECT page_id, item_id, 'h1' AS tag, 3 AS rank, 1 AS nth,
            {_pieces("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS text FROM content_items),
    li AS (SELECT page_id, item_id, 'li' AS tag, 9 AS rank,
            generate_subscripts(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1), 1) AS nth,
            unnest(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)) AS part FROM content_items),
    l AS (SELECT page_id, item_id, tag, rank, nth, {_pieces('part')} AS text FROM li),
    a AS (SELECT page_id, item_id, 'a' AS tag, 13 AS rank, nth, {_pieces('part')} AS text FROM li),
    u AS (SELECT page_id, item_id, tag, rank, nth, trim(regexp_replace(text, '{W}+', ' ', 'g'), ' ') AS text
        FROM (SELECT * FROM p UNION ALL SELECT * FROM d UNION ALL SELECT * FROM h
              UNION ALL SELECT * FROM l UNION ALL SELECT * FROM a)),
    page_rows AS (SELECT page_id, item_id, tag, text, {s_tier('text')} AS tier,
            row_number() OVER (PARTITION BY page_id ORDER BY rank, nth) - 1 AS idx
        FROM u WHERE length(text) >= 5),
    page_paragraphs AS (SELECT *, CASE WHEN tier = 'tier1_short_repeatable' THEN
            min(idx) OVER (PARTITION BY page_id, tier, text) ELSE idx END AS first_idx FROM page_rows)
"""


@query(
    "page_paragraphs",
    _PAGE_SQL
    + """ SELECT page_id, item_id || '_' || idx AS id,
        substr(md5(item_id || '_' || text), 1, 12) AS trans_id, idx, tag, text, tier,
        first_idx < idx AS is_duplicate,
        CASE WHEN first_idx < idx THEN item_id || '_' || first_idx END AS original_id
    FROM page_paragraphs""",
)
def page_paragraphs(v: Views) -> DataFrame:
    rows = pg.page_paragraphs(v.page_elements, ["page_id", "item_id"])
    return rows.drop("doc_pos", "item_id")


@query(
    "extraction_stats",
    _PAGE_SQL
    + """, kept AS (SELECT page_id, count(*) FILTER (first_idx < idx) AS duplicates,
            count(*) FILTER (tier = 'tier1_short_repeatable') AS tier1,
            count(*) FILTER (tier = 'tier2_normal') AS tier2,
            count(*) FILTER (tier = 'tier3_long_complex') AS tier3
        FROM page_paragraphs GROUP BY page_id),
    seen AS (SELECT page_id, len(regexp_extract_all(html, '<(?:p|div|h1|li|a)[ >]')) AS total_tags
        FROM pages)
    SELECT page_id, total_tags, CAST(0 AS BIGINT) AS excluded_tags, coalesce(duplicates, 0) AS duplicates,
        coalesce(tier1, 0) AS tier1, coalesce(tier2, 0) AS tier2, coalesce(tier3, 0) AS tier3
    FROM seen LEFT JOIN kept USING (page_id)""",
)
def extraction_stats(v: Views) -> DataFrame:
    return pg.extraction_stats(v.page_elements, ["page_id"])


@query(
    "doc_title",
    r"""WITH t AS (SELECT page_id, trim(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&amp;', '&'), ' ') AS t,
            trim(replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '&amp;', '&'), ' ') AS h FROM pages)
        SELECT page_id, CASE WHEN length(t) BETWEEN 1 AND 99 THEN t
            WHEN length(h) BETWEEN 1 AND 99 THEN h END AS title FROM t""",
)
def doc_title(v: Views) -> DataFrame:
    return pg.first_headings(v.page_elements, ["page_id"])


_RANKS = " ".join(f"WHEN '{t}' THEN {n}" for n, t in enumerate(P.CONTENT_TAGS, 1))


@query(
    "paragraph_ids",
    f"""SELECT book_id, pos, tag, row_number() OVER (PARTITION BY book_id
            ORDER BY CASE tag {_RANKS} END, pos) - 1 AS idx FROM nodes""",
)
def paragraph_ids(v: Views) -> DataFrame:
    numbered = pg.number_elements(v.nodes, "book_id", "tag", "pos", span=1 << 31)
    return numbered.select("book_id", "pos", "tag", "idx")


@query(
    "tier1_dups",
    f"""WITH t AS (SELECT book_id, pos, text, {s_tier('text')} AS tier FROM nodes),
        f AS (SELECT *, CASE WHEN tier = 'tier1_short_repeatable'
            THEN min(pos) OVER (PARTITION BY book_id, tier, text) ELSE pos END AS first_pos FROM t)
        SELECT book_id, pos, tier, first_pos, first_pos < pos AS is_duplicate FROM f""",
)
def tier1_dups(v: Views) -> DataFrame:
    return pg.mark_repeats(v.nodes, "book_id", "pos").select(
        "book_id", "pos", "tier", "first_pos", "is_duplicate"
    )


@query(
    "sample_paragraphs",
    """SELECT book_id, pos, text FROM (SELECT *, row_number() OVER (PARTITION BY book_id
        ORDER BY pos) AS rn FROM paragraphs) WHERE rn <= 50""",
)
def sample_paragraphs(v: Views) -> DataFrame:
    """The operator's feature is the limit: the first 50 paragraphs of every book."""
    return first_rows(v.paragraphs, ["book_id"], [F.col("pos")], 50)


@query(
    "char_batches",
    f"""WITH RECURSIVE t AS (SELECT book_id, {s_tier('text')} AS tier, pos, length(text) AS n FROM nodes),
        o AS (SELECT *, row_number() OVER (PARTITION BY book_id, tier ORDER BY pos) AS rn FROM t),
        walk AS (SELECT book_id, tier, pos, rn, n AS fill, CAST(0 AS BIGINT) AS batch_no FROM o WHERE rn = 1
            UNION ALL
            SELECT o.book_id, o.tier, o.pos, o.rn,
                CASE WHEN w.fill + o.n > 1800 THEN o.n ELSE w.fill + o.n END,
                w.batch_no + CASE WHEN w.fill + o.n > 1800 THEN 1 ELSE 0 END
            FROM walk w JOIN o ON o.book_id = w.book_id AND o.tier = w.tier AND o.rn = w.rn + 1)
        SELECT book_id, tier, pos, batch_no FROM walk""",
)
def char_batches(v: Views) -> DataFrame:
    sized = v.nodes.select("book_id", tier(F.col("text")).alias("tier"), "pos",
                           F.length("text").alias("chars"))
    return batching.char_batches(sized, ["book_id", "tier"], "pos", "chars")


@query(
    "fixed_batches",
    f"""WITH t AS (SELECT book_id, {s_tier('text')} AS tier, pos FROM nodes)
        SELECT book_id, tier, pos, (row_number() OVER (PARTITION BY book_id, tier ORDER BY pos) - 1)
            // CASE tier WHEN 'tier1_short_repeatable' THEN 15 WHEN 'tier2_normal' THEN 8 ELSE 1 END
            AS batch_no FROM t""",
)
def fixed_batches(v: Views) -> DataFrame:
    tiered = v.nodes.select("book_id", tier(F.col("text")).alias("tier"), "pos")
    return batching.fixed_batches(
        tiered, ["book_id", "tier"], "pos", batching.tier_batch_size(F.col("tier"))
    )


# ---- chapters -------------------------------------------------------------------------


def _lines(v: Views) -> DataFrame:
    return ch.chapter_lines(v.nodes, "book_id", "pos")


@query(
    "chapter_lines",
    """SELECT book_id, pos, tag, text, is_heading, chapter_no FROM chapter_numbers
       WHERE is_heading OR tag <> 'h1'""",
)
def chapter_lines(v: Views) -> DataFrame:
    return _lines(v).select("book_id", "pos", "tag", "text", "is_heading", "chapter_no")


@query("chapters", "SELECT * FROM chapter_table")
def chapters(v: Views) -> DataFrame:
    return ch.chapters(_lines(v), "book_id", "pos")


_FALLBACK = """fallback AS (SELECT *, coalesce(t, '第' || chapter_no || '章') AS title FROM (
        SELECT source AS book_id, doc_id AS pos, substr(text, 1, 5000) AS content,
            CASE WHEN length(string_split(text, chr(10))[1]) BETWEEN 1 AND 99
                THEN string_split(text, chr(10))[1] END AS t,
            row_number() OVER (PARTITION BY source ORDER BY doc_id) AS chapter_no
        FROM documents WHERE length(text) > 500) WHERE chapter_no <= 10)"""


def _fallback(v: Views) -> DataFrame:
    head = F.get(F.split("text", "\n"), F.lit(0))
    items = v.documents.select(
        F.col("source").alias("book_id"), F.col("doc_id").alias("pos"), "text",
        F.when(F.length(head).between(1, 99), head).alias("title"),
    )
    return ch.fallback_chapters(items, "book_id", "pos")


@query(
    "fallback_chapters",
    f"WITH {_FALLBACK} SELECT book_id, chapter_no, pos, title, content FROM fallback",
)
def fallback_chapters(v: Views) -> DataFrame:
    """Sources as books, their documents as items; ten per book is the operator's limit."""
    return _fallback(v)


@query(
    "summary_context",
    f"""WITH {_FALLBACK} SELECT book_id, string_agg(title || ':' || chr(10) || content,
        chr(10) || chr(10) ORDER BY chapter_no) AS context
        FROM fallback WHERE chapter_no <= 8 GROUP BY book_id""",
)
def summary_context(v: Views) -> DataFrame:
    return ch.context(_fallback(v), "book_id")


@query(
    "summary_digest",
    f"""WITH {_FALLBACK} SELECT book_id, string_agg('## ' || title || chr(10) || chr(10)
        || substr(content, 1, 500), chr(10) || chr(10) ORDER BY chapter_no) AS context
        FROM fallback WHERE chapter_no <= 5 GROUP BY book_id""",
)
def summary_digest(v: Views) -> DataFrame:
    return ch.context(_fallback(v), "book_id", n=5, chars=500, layout="digest")


@query(
    "suitability",
    """WITH t AS (SELECT book_id, CAST(sum(length(text)) AS BIGINT) AS total_chars FROM nodes GROUP BY book_id),
        c AS (SELECT book_id, count(*) AS n_chapters, CAST(sum(n_chars) AS BIGINT) AS content_chars
            FROM chapter_table GROUP BY book_id)
        SELECT book_id, coalesce(n_chapters, 0) AS n_chapters,
            coalesce(content_chars, 0) AS content_chars, total_chars,
            coalesce(n_chapters, 0) >= 3 AS enough_chapters,
            coalesce(content_chars, 0) / total_chars >= 0.5 AS enough_content
        FROM t LEFT JOIN c USING (book_id)""",
)
def suitability(v: Views) -> DataFrame:
    lines = _lines(v)
    sizes = (
        lines.where(~F.col("is_heading") & (F.length("text") > 0))
        .groupBy("book_id", "chapter_no")
        .agg(F.sum(F.length("text") + 1).alias("n_chars"))
    )
    totals = v.nodes.groupBy("book_id").agg(F.sum(F.length("text")).alias("total_chars"))
    return ch.suitability(sizes, totals, "book_id")
