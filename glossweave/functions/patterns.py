"""Character classes, word lists and limits that results depend on.

Patterns use explicit Unicode classes instead of \\s, \\d, \\w, and no \\b next to
non-ASCII text, so that they do not depend on the Java version.
"""

from __future__ import annotations

# White space as Python's str.split() and str.strip() see it: the Unicode property plus
# the four separators 1c-1f. The list holds the same characters for trimming.
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
NOT_BLANK_SPACE = r"[\p{IsWhite_Space}\x1c-\x1f&&[^ ]]"
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
FOLDED = [("—", "-"), ("–", "-"), ("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("…", "...")]
WORD = r"[\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"

# ---- paragraph tiers (fixed values) ----
SHORT_MAX = 30
LONG_MIN = 200
MIN_TEXT = 5
SHORT_FORMS = [
    rf"Figure{SPACE}+{DIGIT}",
    rf"Table{SPACE}+{DIGIT}",
    rf"Chapter{SPACE}+{DIGIT}",
    rf"Section{SPACE}+{DIGIT}",
    rf"Appendix{SPACE}+[A-Z]",
    rf"{DIGIT}[.{DIGIT}]*{SPACE}+{WORD}",
    rf"[A-Z][.)]{SPACE}",
    rf"Listing{SPACE}+{DIGIT}",
    rf"Example{SPACE}+{DIGIT}",
]
SHORT_FORM = r"\A(?:" + "|".join(SHORT_FORMS) + ")"

# ---- page elements (fixed values) ----
EXCLUDED_TAGS = ["script", "style", "nav", "header", "footer"]
EXCLUDED_MARKS = [
    r"nav\b",
    r"\bmenu\b",
    r"navbar",
    r"\bheader\b",
    r"\bfooter\b",
    r"\bindex\b",
    r"pagination",
    r"\bprev\b",
    r"\bnext\b",
]
EXCLUDED_MARK = "|".join(EXCLUDED_MARKS)
CONTENT_TAGS = [
    "p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd",
    "blockquote", "a", "figcaption", "td", "th", "caption",
]  # in priority order
BLOCK_TAGS = [
    "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "table",
]
HEADING_TAGS = ["h1", "h2", "h3"]
HEADING_MAX = 100

# ---- alignment (fixed values) ----
PREFIX_CHARS = 80
SIGNATURE_CHARS = 200
LOOSE_MIN = 50
LEADING_LABEL = (
    rf"\A(?:Part{SPACE}+{DIGIT}+\.?{SPACE}*|Appendix{SPACE}+[A-Z]\.?{SPACE}*"
    rf"|{DIGIT}+(?:\.{DIGIT}+)*{SPACE}*)"
)
ADMONITIONS = {
    "Note": "注意", "NOTE": "注意", "note": "注意",
    "Tip": "提示", "TIP": "提示", "tip": "提示",
    "Warning": "警告", "WARNING": "警告", "warning": "警告",
    "Caution": "注意", "CAUTION": "注意", "caution": "注意",
    "Important": "重要", "IMPORTANT": "重要", "important": "重要",
}

# ---- quality (fixed values) ----
CJK = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]"
LATIN_WORD = rf"(?<!{WORD})(?!http|www)[a-zA-Z]{{2,}}(?!{WORD})"
LIST_ITEM = rf"\A(?:{SPACE}*[-*]{SPACE}|{DIGIT}+[.)]{SPACE})"
WESTERN_DATE = rf"{DIGIT}{{1,2}}[/-]{DIGIT}{{1,2}}[/-]{DIGIT}{{2,4}}"
IMPERIAL_UNIT = (
    "inches?|inch|feet|foot|ft|pounds?|lbs?|miles?|yards?|ounces?|oz|gallons?|gals?"
    "|fahrenheit|°f"
)
IMPERIAL = (
    rf"(?iu)(?<!{WORD}){DIGIT}+\.?{DIGIT}*{SPACE}*(?:{IMPERIAL_UNIT})(?!{WORD})"
)
CURRENCY = r"[$€£¥]"
GLOSSARY = {
    "api": "API", "database": "数据库", "server": "服务器", "client": "客户端",
    "interface": "接口", "module": "模块", "configuration": "配置", "function": "函数",
    "algorithm": "算法", "protocol": "协议", "authentication": "认证",
    "authorization": "授权",
}
GRADE_LIMITS = {"excellent": 90, "good": 75, "pass": 60}
GRADES = {"excellent": "优秀", "good": "良好", "pass": "合格", "fail": "需改进"}
NO_GRADE = "无法评估"

# ---- translation gate (fixed values) ----
GATE = {
    "min_ratio": 0.2, "max_ratio": 3.0, "long_min_ratio": 0.1, "long_max_ratio": 5.0,
    "short_max": 30, "short_min_chars": 3, "retry_min": 50,
}
CODE_MARK = r"[{(\[=<>\\`|&]"
RESIDUE = ["===", "[段落"]

# ---- batching and inference (fixed values) ----
BATCH_CHARS = 1800
BATCH_SIZES = {"tier1_short_repeatable": 15, "tier2_normal": 8, "tier3_long_complex": 1}
TOKEN_FLOOR = 500
TOKEN_CAP = 4000

# ---- table of contents (fixed values) ----
TOC_SKIP = (
    rf"(?i)\A(?:cover|title{SPACE}*page|copyright|dedication|contents?|epigraph|"
    rf"acknowledg?ments?|notes?|about{SPACE}+the{SPACE}+author|index|bibliography|"
    rf"foreword|preface|part{SPACE}+[ivx0-9]+|page{SPACE}+mapping[^\n]*|"
    rf"目录|扉页|版权|献辞|致谢|注释|附录|参考文献|前言|序言|后记|作者简介){SPACE}*\z"
)
ROMAN = r"(?i)\A[ivxlcdm]+\z"

# ---- book kinds (fixed values) ----
BOOK_KINDS = [
    ("技术编程", ["python", "编程", "代码", "程序"]),
    ("商业管理", ["商业", "创业", "管理"]),
    ("小说文学", ["小说", "文学", "故事"]),
]
BOOK_KIND_OTHER = "通用"

# ---- shop and money (fixed values) ----
PRICES = {"input": 1.0, "output": 2.0}  # per million tokens
BUSY_STATUSES = [
    "scanning", "parsing", "translating", "summarizing", "extracting", "copywriting",
]
MEMORY_TTL_SECONDS = 30 * 24 * 60 * 60
ERROR_CHARS = 1000
ERROR_PREVIEW = 80

# ---- chapters (fixed values) ----
PREFACE = "前言"
CHAPTER_LIMIT = 10
CHAPTER_CHARS = 5000
ITEM_MIN_CHARS = 500
EDITIONS = ["双语", "中文", "英文"]  # bilingual, target, source
