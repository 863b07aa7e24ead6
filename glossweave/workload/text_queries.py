"""Text, name, markdown and reply functions over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.functions import markdown, names, text
from glossweave.functions import patterns as P
from glossweave.operators import gate as gates
from glossweave.operators import replies
from glossweave.workload.registry import query
from glossweave.workload.views import Views, W, rx, s_count, s_fold, s_squeeze, s_strip, s_tier, stand_in



@query(
    "norm_text",
    f"SELECT doc_id, {s_squeeze('text')} AS norm, length({s_squeeze('text')}) AS n_chars FROM documents",
)
def norm_text(v: Views) -> DataFrame:
    norm = text.squeeze(F.col("text"))
    return v.documents.select("doc_id", norm.alias("norm"), F.length(norm).alias("n_chars"))


@query(
    "norm_text2",
    f"""SELECT conv_id, turn, {s_fold("text || ' – “x”…'")} AS norm FROM conversations""",
)
def norm_text2(v: Views) -> DataFrame:
    raw = F.concat("text", F.lit(" – “x”…"))
    return v.table("conversations").select("conv_id", "turn", text.fold(raw).alias("norm"))


@query("text_tier", f"SELECT book_id, pos, {s_tier('text')} AS tier FROM nodes")
def text_tier(v: Views) -> DataFrame:
    return v.nodes.select("book_id", "pos", text.tier(F.col("text")).alias("tier"))


@query(
    "trans_id",
    """SELECT book_id, pos, substr(md5(filename || '_' || text), 1, 12) AS trans_id
       FROM paragraphs JOIN books USING (book_id)""",
)
def trans_id(v: Views) -> DataFrame:
    return v.paragraphs.join(v.books.select("book_id", "filename"), "book_id").select(
        "book_id", "pos", text.trans_id(F.col("filename"), F.col("text")).alias("trans_id")
    )


@query(
    "clean_filename",
    r"""SELECT page_id, regexp_replace(url, '[<>:"/\\|?*]', '_', 'g') AS clean FROM pages""",
)
def clean_filename(v: Views) -> DataFrame:
    return v.pages.select("page_id", names.clean_filename(F.col("url")).alias("clean"))


_STEM_SQL = rf"""
    WITH n AS (SELECT book_id, title || CASE WHEN book_id % 2 = 0 THEN '--' || filename
            ELSE ' ' || title || ' .epub' END AS name FROM books),
    s AS (SELECT book_id, name, {s_strip("substr(name, 1, length(name) - 5)")} AS stem FROM n),
    c AS (SELECT book_id, name, stem, {s_strip("string_split(stem, '--')[1]")} AS head FROM s)
    SELECT book_id, name, stem || '.epub' AS trimmed,
        CASE WHEN length(head) > 60 THEN {s_strip("substr(head, 1, 60)")} ELSE head END
            || '.epub' AS fixed
    FROM c"""


@query("fix_stem", _STEM_SQL)
def fix_stem(v: Views) -> DataFrame:
    name = F.concat(
        "title",
        F.when(F.col("book_id") % 2 == 0, F.concat(F.lit("--"), "filename")).otherwise(
            F.concat(F.lit(" "), "title", F.lit(" .epub"))
        ),
    )
    return v.books.select("book_id", name.alias("name")).select(
        "book_id", "name",
        names.trim_stem(F.col("name")).alias("trimmed"),
        names.fix_stem(F.col("name")).alias("fixed"),
    )


@query(
    "title_from_filename",
    rf"""SELECT book_id, {s_strip(f"regexp_replace(regexp_replace(substr(filename, 1, length(filename) - 5), '[-_]+', ' ', 'g'), '{W}+', ' ', 'g')")} AS title FROM books""",
)
def title_from_filename(v: Views) -> DataFrame:
    return v.books.select("book_id", names.title_from_filename(F.col("filename")).alias("title"))


@query(
    "truncate_text",
    """SELECT book_id, pos, CASE WHEN length(text) <= 100 THEN text
        ELSE substr(text, 1, 97) || '...' END AS short FROM paragraphs""",
)
def truncate_text(v: Views) -> DataFrame:
    return v.paragraphs.select("book_id", "pos", text.truncate(F.col("text")).alias("short"))


_KIND_TITLES = (
    "title || CASE book_id % 5 WHEN 0 THEN ' Python 编程' WHEN 1 THEN ' 创业与管理' "
    "WHEN 2 THEN ' 文学故事' WHEN 3 THEN ' PYTHON' ELSE '' END"
)


def _kind_title():
    way = F.col("book_id") % 5
    return F.concat(
        "title",
        F.when(way == 0, " Python 编程").when(way == 1, " 创业与管理").when(way == 2, " 文学故事")
        .when(way == 3, " PYTHON").otherwise(""),
    )


@query(
    "book_type",
    f"""SELECT book_id, CASE
        WHEN regexp_matches(lower({_KIND_TITLES}), 'python|编程|代码|程序') THEN '技术编程'
        WHEN regexp_matches(lower({_KIND_TITLES}), '商业|创业|管理') THEN '商业管理'
        WHEN regexp_matches(lower({_KIND_TITLES}), '小说|文学|故事') THEN '小说文学'
        ELSE '通用' END AS book_type FROM books""",
)
def book_type(v: Views) -> DataFrame:
    return v.books.select("book_id", text.book_kind(_kind_title()).alias("book_type"))


@query(
    "summary_text",
    """SELECT doc_id, '书名：' || string_split(text, chr(10))[1] || chr(10) || '作者：' || source || chr(10)
        || '类型：通用' || chr(10) || '' || chr(10) || text AS summary FROM documents""",
)
def summary_text(v: Views) -> DataFrame:
    docs = v.documents
    title = F.get(F.split("text", "\n"), F.lit(0))
    return docs.select(
        "doc_id",
        text.summary_text(title, F.col("source"), F.lit("通用"), F.col("text")).alias("summary"),
    )


@query(
    "html_escape",
    r"""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'),
        '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM pages""",
)
def html_escape(v: Views) -> DataFrame:
    return v.pages.select("page_id", text.html_escape(F.col("html")).alias("escaped"))


_TAGS_SQL = rf"regexp_replace(regexp_replace(html, '(?i)<br{W}*/?>', ' ', 'g'), '<[^>]+>', '', 'g')"
for _from, _to in ((r"\*\*([^\n]+?)\*\*", r"<b>\1</b>"), (r"\*([^\n]+?)\*", r"<i>\1</i>"),
                   (r"`([^\n]+?)`", r'<font name="Courier">\1</font>')):
    _TAGS_SQL = f"regexp_replace({_TAGS_SQL}, '{_from}', '{_to}', 'g')"


@query("strip_tags", f"SELECT page_id, {s_strip(_TAGS_SQL)} AS plain FROM pages")
def strip_tags(v: Views) -> DataFrame:
    return v.pages.select("page_id", text.strip_tags(F.col("html")).alias("plain"))


@query(
    "template_fill",
    """SELECT book_id, replace(replace('书名：{title} 作者：{author} :root { --x: {other} }',
        '{title}', title), '{author}', author) AS filled FROM books""",
)
def template_fill(v: Views) -> DataFrame:
    template = F.lit("书名：{title} 作者：{author} :root { --x: {other} }")
    return v.books.select(
        "book_id", text.fill(template, title=F.col("title"), author=F.col("author")).alias("filled")
    )


@query(
    "ncx_labels",
    """SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY pos) - 1 AS nth,
        replace(text, '<', '') AS label FROM paragraphs WHERE replace(text, '<', '') <> ''""",
)
def ncx_labels(v: Views) -> DataFrame:
    """Navigation files are put together from the lines of each document (one cell per
    book), then their labels are read back."""
    lines = F.filter(
        F.transform(
            F.split("text", "\n"),
            lambda line, i: F.struct(i.alias("pos"), text.squeeze(line).alias("text")),
        ),
        lambda p: F.length(p.text) >= P.MIN_TEXT,
    )
    label = F.transform(
        lines,
        lambda p: F.concat(
            F.lit("<navLabel><text>"), F.replace(p.text, F.lit("<"), F.lit("")),
            F.lit("</text></navLabel>"),
        ),
    )
    ncx = v.documents.select(
        F.col("doc_id").alias("book_id"), F.array_join(label, "\n").alias("ncx")
    )
    return ncx.select("book_id", F.posexplode(text.toc_labels(F.col("ncx"))).alias("nth", "label"))


@query(
    "toc_body",
    rf"""WITH entries AS (SELECT p.book_id, p.pos, b.title, p.text, CASE p.pos % 9
            WHEN 0 THEN 'Cover' WHEN 1 THEN 'Part IV ' WHEN 2 THEN 'xiv'
            WHEN 3 THEN CAST(p.pos AS VARCHAR) WHEN 4 THEN b.title WHEN 5 THEN ' 目录' END AS beside
        FROM paragraphs p JOIN books b USING (book_id)),
    l AS (SELECT book_id, pos * 2 AS pos, title, {s_strip('text')} AS label FROM entries
        UNION ALL
        SELECT book_id, pos * 2 + 1, title, {s_strip('beside')} FROM entries WHERE beside IS NOT NULL)
    SELECT book_id, pos, label FROM l
    WHERE label <> '' AND NOT regexp_matches(label, '{rx(P.TOC_SKIP)}')
        AND NOT regexp_matches(label, '{P.ROMAN}')
        AND NOT regexp_matches(label, '\A[0-9]+\z')
        AND ({s_strip('title')} = '' OR lower(label) <> lower({s_strip('title')}))""",
)
def toc_body(v: Views) -> DataFrame:
    """Every line is an entry; entries of other kinds stand beside some of them."""
    way, pos = F.col("pos") % 9, F.col("pos")
    beside = (
        F.when(way == 0, "Cover").when(way == 1, "Part IV ").when(way == 2, "xiv")
        .when(way == 3, pos.cast("string")).when(way == 4, F.col("title")).when(way == 5, " 目录")
    )
    entries = F.array(
        F.struct((pos * 2).alias("pos"), F.col("text").alias("label")),
        F.when(beside.isNotNull(), F.struct((pos * 2 + 1).alias("pos"), beside.alias("label"))),
    )
    labelled = v.paragraphs.join(v.books.select("book_id", "title"), "book_id").select(
        "book_id", "title", F.explode(F.array_compact(entries)).alias("e")
    ).select("book_id", "e.pos", "title", text.strip(F.col("e.label")).alias("label"))
    return labelled.where(text.is_toc_body(F.col("label"), F.col("title"))).select(
        "book_id", "pos", "label"
    )


# ---- markdown -------------------------------------------------------------------------

_MD_LINES = r"""
    WITH md_lines AS (SELECT book_id, unnest(string_split(md, chr(10))) AS line,
            generate_subscripts(string_split(md, chr(10)), 1) - 1 AS line_no FROM markdown),
    fenced AS (SELECT *, starts_with({strip}, '```') AS fence,
            sum(CASE WHEN starts_with({strip}, '```') THEN 1 ELSE 0 END)
                OVER (PARTITION BY book_id ORDER BY line_no) AS fences FROM md_lines)""".replace(
    "{strip}", s_strip("line")
)


@query(
    "md_plain",
    _MD_LINES
    + r""" SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY line_no) - 1 AS nth,
        regexp_replace(regexp_replace(regexp_replace(line, '\*\*([^*]+)\*\*', '\1', 'g'),
            '\*([^*]+)\*', '\1', 'g'), '`([^`]+)`', '\1', 'g') AS line
    FROM fenced WHERE NOT fence AND fences % 2 = 0""",
)
def md_plain(v: Views) -> DataFrame:
    return v.markdown.select(
        "book_id", F.posexplode(markdown.plain_lines(F.col("md"))).alias("nth", "line")
    )


@query(
    "md_toc",
    _MD_LINES
    + rf""" SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY line_no) - 1 AS nth,
        CASE WHEN starts_with(line, '## ') THEN 'h2' WHEN starts_with(line, '### ') THEN 'h3'
            ELSE 'h1' END AS level,
        {s_strip("regexp_replace(line, '^#+ ', '')")} AS label
    FROM fenced WHERE regexp_matches(line, '^#{{1,3}} ')""",
)
def md_toc(v: Views) -> DataFrame:
    return v.markdown.select(
        "book_id", F.posexplode(markdown.headings(F.col("md"))).alias("nth", "h")
    ).select("book_id", "nth", "h.level", "h.label")


_BLOCKS_SQL = rf"""
    WITH raw AS (SELECT book_id, unnest(string_split(md, chr(10))) AS line,
            generate_subscripts(string_split(md, chr(10)), 1) - 1 AS line_no FROM markdown),
    clean AS (SELECT book_id, line_no, regexp_replace(regexp_replace(line, '{W}+\z', ''),
            '<[^>]+>', '', 'g') AS line FROM raw),
    body AS (SELECT *, {s_strip('line')} AS body, starts_with(line, '```') AS fence FROM clean),
    fenced AS (SELECT *, sum(CASE WHEN fence THEN 1 ELSE 0 END)
            OVER (PARTITION BY book_id ORDER BY line_no) AS fences FROM body),
    own AS (SELECT *, CASE WHEN fence THEN 'fence' WHEN fences % 2 = 1 THEN 'code'
            WHEN starts_with(body, '|') AND contains(substr(body, 2), '|') THEN
                CASE WHEN regexp_matches(body, '\A\|(?:[-: ]*\|)*[^|]*\z')
                    THEN 'table_separator' ELSE 'table_row' END
            WHEN starts_with(line, '### ') THEN 'h4' WHEN starts_with(line, '## ') THEN 'h2'
            WHEN starts_with(line, '# ') THEN 'h3'
            WHEN starts_with(body, '- ') OR starts_with(body, '* ') THEN 'ul'
            WHEN regexp_matches(body, '\A[0-9]+\.{W}') THEN 'ol'
            WHEN starts_with(line, '>') THEN 'quote'
            WHEN body IN ('---', '***', '___') THEN 'rule'
            WHEN body <> '' THEN 'p' ELSE 'blank' END AS own FROM fenced),
    state AS (SELECT *,
            last_value(CASE WHEN own = 'table_row' THEN 1
                WHEN own NOT IN ('fence', 'code', 'table_separator') THEN 0 END IGNORE NULLS) OVER w AS tab,
            last_value(CASE WHEN own IN ('ul', 'ol') THEN 1
                WHEN own IN ('quote', 'rule', 'p', 'blank') THEN 0 END IGNORE NULLS) OVER w AS lst
        FROM own WINDOW w AS (PARTITION BY book_id ORDER BY line_no
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT book_id, line_no, CASE WHEN own = 'table_row' AND coalesce(tab, 0) = 0 THEN 'table_head'
            WHEN own IN ('quote', 'rule') AND coalesce(lst, 0) = 1 THEN 'p' ELSE own END AS kind,
        line FROM state"""


@query("md_blocks", _BLOCKS_SQL)
def md_blocks(v: Views) -> DataFrame:
    return markdown.blocks(v.markdown, ["book_id"], "md")


# ---- gate and replies -----------------------------------------------------------------

_GATE_ROWS = f"""
    WITH g AS (SELECT book_id, pos, original, {s_tier('original')} AS tier,
        translated FROM (
            SELECT book_id, pos, original, CASE WHEN book_id % 3 = 0 THEN translated || '=== [段落'
                ELSE translated || translated END AS translated FROM segments
            UNION ALL SELECT book_id, pos + 300000, original, ' ' FROM segments WHERE (book_id * 7 + pos) % 5 = 0
            UNION ALL SELECT book_id, pos + 400000, original, 'short' FROM segments WHERE pos % 4 = 2) s),
    r AS (SELECT *, length(original) AS n, length(translated) AS m,
        {s_strip('translated')} = '' AS blank, length(translated) / length(original) AS ratio FROM g),
    c AS (SELECT *, NOT blank AND CASE WHEN n <= 30 THEN m < 3
            WHEN tier = 'tier3_long_complex' THEN ratio < 0.1 ELSE ratio < 0.2 END AS too_short,
        NOT blank AND CASE WHEN n <= 30 THEN tier <> 'tier3_long_complex' AND ratio > 3
            WHEN tier = 'tier3_long_complex' THEN ratio > 5 ELSE ratio > 3 END AS too_long,
        NOT blank AND NOT regexp_matches(original, '[{{(\\[=<>\\\\`|&]')
            AND (contains(translated, '===') OR contains(translated, '[段落')) AS residue FROM r)
    SELECT book_id, pos, tier, array_to_string(list_filter([
            CASE WHEN blank THEN '空翻译' END, CASE WHEN too_short THEN '翻译过短' END,
            CASE WHEN too_long THEN '翻译过长' END, CASE WHEN residue THEN '分隔符残留' END],
            lambda x: x IS NOT NULL), '|') AS issues,
        CASE WHEN blank THEN 'keep_original' WHEN too_short THEN 'keep'
            WHEN NOT (too_long OR residue) THEN 'ok' WHEN n > 50 THEN 'retry' ELSE 'keep' END AS action,
        CASE WHEN blank THEN original ELSE translated END AS final_text
    FROM c"""


def gate_rows(v: Views) -> DataFrame:
    """Every answer, and beside some of them a blank and a short one."""
    t, pos = F.col("translated"), F.col("pos")

    def answer(at: Column, translated: Column) -> Column:
        return F.struct(at.alias("pos"), translated.alias("translated"))

    answers = F.array(
        answer(pos, F.when(F.col("book_id") % 3 == 0, F.concat(t, F.lit("=== [段落"))).otherwise(F.concat(t, t))),
        F.when((F.col("book_id") * 7 + pos) % 5 == 0, answer(pos + 300000, F.lit(" "))),
        F.when(pos % 4 == 2, answer(pos + 400000, F.lit("short"))),
    )
    return v.segments.select(
        "book_id", "original", text.tier(F.col("original")).alias("tier"), F.explode(F.array_compact(answers)).alias("a")
    ).select("book_id", "a.pos", "original", "tier", "a.translated")


@query("segment_gate", _GATE_ROWS)
def segment_gate(v: Views) -> DataFrame:
    return gates.gate(gate_rows(v)).select(
        "book_id", "pos", "tier", F.array_join("issues", "|").alias("issues"), "action", "final_text"
    )


@query(
    "all_empty_books",
    f"""WITH fresh AS (SELECT book_id, translated FROM segments
            UNION ALL SELECT -1 - book_id, ' ' || chr(10) FROM segments WHERE book_id % 3 = 0)
        SELECT book_id, count(*) AS n_fresh FROM fresh GROUP BY book_id
        HAVING bool_and({s_strip('translated')} = '')""",
)
def all_empty_books(v: Views) -> DataFrame:
    """Every book as it is, and beside each third one a book whose run gave only blanks."""
    book = F.col("book_id")
    rows = F.array(
        F.struct("book_id", "translated"),
        F.when(book % 3 == 0, F.struct((-1 - book).alias("book_id"), F.lit(" \n").alias("translated"))),
    )
    fresh = v.segments.select(F.explode(F.array_compact(rows)).alias("r")).select(
        "r.book_id", F.lit(False).alias("is_duplicate"), "r.translated"
    )
    return gates.all_empty_books(fresh)


@query(
    "batch_prompt",
    """WITH n AS (SELECT book_id, pos, text,
            row_number() OVER (PARTITION BY book_id ORDER BY pos) - 1 AS rn FROM paragraphs),
        b AS (SELECT book_id, rn // 8 AS batch_no,
            string_agg('[' || (rn % 8 + 1) || '] ' || text, chr(10) || chr(10) ORDER BY rn) AS prompt,
            count(*) AS n_items FROM n GROUP BY book_id, rn // 8)
        SELECT book_id, batch_no, n_items, prompt,
            least(length(prompt) * 2 + 500, 4000) AS max_tokens FROM b""",
)
def batch_prompt(v: Views) -> DataFrame:
    from glossweave.operators.batching import fixed_batches

    batched = fixed_batches(v.paragraphs, ["book_id"], "pos", 8)
    return replies.compose(batched, ["book_id", "batch_no"], "pos")


def _replies(v: Views) -> DataFrame:
    """Stand-in replies: a document's own lines numbered by five, so numbers repeat."""
    numbered = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.concat(
            F.lit("["), (i % 5 + 1).cast("string"), F.lit("]  "),
            F.translate(line, "[]", "()"), F.lit(" "),
        ),
    )
    return v.documents.select(
        F.col("doc_id").alias("book_id"),
        F.concat(F.lit("Sure: "), F.array_join(numbered, "\n")).alias("reply"),
    )


@query(
    "batch_parse",
    f"""SELECT book_id, pos % 5 + 1 AS item_no,
        arg_max({s_strip("translate(line, '[]', '()')")}, pos) AS translated
        FROM text_lines GROUP BY book_id, pos % 5""",
)
def batch_parse(v: Views) -> DataFrame:
    return replies.parse_replies(_replies(v), ["book_id"])


@query("reply_json")
def reply_json(v: Views) -> DataFrame:
    body = F.to_json(
        F.struct(
            F.struct(F.col("title")).alias("page1"),
            F.array("author", "language").alias("page2"),
            F.struct(F.col("filename")).alias("page3"),
            F.when(F.col("status") != "failed", F.array("status")).alias("page4"),
        )
    )
    wrapped = F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    asked = v.books.select(
        "book_id",
        F.when(F.col("status") == "pending", F.lit("no json here")).otherwise(wrapped).alias("reply"),
    )
    return replies.parse_pages(asked, ["book_id"])
