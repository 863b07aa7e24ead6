"""Secrets: patterns, and strings whose windows look random for their character class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.llm.common import fresh
from glossweave.llm.spans import in_order, replaced, spans_of

KINDS = ("assign", "access", "hex")
ASSIGN = (
    r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
)
#: What follows the sign in an assignment; matched again inside a match to judge its length.
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run is taken whole, so a match begins where a run of its class begins.
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
#: Candidate strings: whole runs of key characters.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: Alphabets: pattern of a whole candidate, least bits of its most random window. Of random strings of 20
#: characters 0.5 % stay below (60 000 drawn each; of 10, 16, 26, 32, 52 and 62 symbols). Letters alone of one
#: case and such letters with digits, from base32 on, have limits of their own; the first that fits counts.
CLASSES = (
    ("digit", r"^[0-9]+$", 2.43), ("hexadecimal", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 2.82),
    ("letters", r"^(?:[a-z_=/+-]+|[A-Z_=/+-]+)$", 3.14), ("one case", r"^(?:[a-z0-9_=/+-]+|[A-Z0-9_=/+-]+)$", 3.28),
    ("mixed case", r"^[A-Za-z_=/+-]+$", 3.52), ("base64", r"^.*$", 3.58),
)
WINDOW = 20
#: Candidates that are no secrets: runs of one sign, and well-known placeholders.
ALLOWED = r"^(.)\1*$|(?i:example|placeholder|changeme|x{6,}|0123456789|abcdefgh)"
#: Pairs of letters that are common in words of several European languages.
COMMON = (
    "ab ac ad ag ai al am an ap ar as at au ba be bl bu ca ce ch ci ck cl co ct da de di do ea ec ed ee "
    "ei el em en eq er es et eu ex fi fo fr ge gi gr ha he hi ho ht hu ib ic id ie if ig il im in io ir "
    "is it ke la le li ll lo ls ly ma me mi mm mo mp na nc nd ne ng ni no ns nt oc od og oi ol om on oo "
    "op or os ot ou ov ow pa pe pi pl po pp pr ps py qu ra re ri rk rm ro rs rt ry sc se si so ss st su "
    "ta te th ti to tp tr ts tt ty tz ub ue ui ul um un ur us ut ve vi wi wo xt yo yp yt za "
).split()
#: Of the letter pairs of words at least this share is common; of 20 random letters 0.2 % reach it.
WORDY = 0.6
#: Least share of letter pairs among the pairs without signs for a candidate to be words.
LETTERS = 0.65


def base_spans(text: Column) -> Column:
    """Spans of the three base patterns in a text that is not null, by start and then kind."""
    found = [
        spans_of(
            text, ASSIGN, "assign", 0, text.rlike(r"(?i)(?:password|passwd|secret|token|api_?key)"),
            lambda v: F.length(F.regexp_extract(v, ASSIGN_VALUE, 1)) >= 6,
        ),
        spans_of(text, ACCESS, "access", 1, text.contains("AKIA"), lambda v: F.length(v) >= 20),
        spans_of(text, HEX, "hex", 2, text.rlike(HEX)),
    ]
    return F.concat(*found)


def window_entropy(value: Column, window: int = WINDOW) -> Column:
    """The most bits per character of any `window` characters in a row.

    The counts of the characters in the window are kept in a map of code to count as one
    character enters and one leaves, and so is the sum of c * log2(c) over the counts c, of
    which entropy is log2(window) - sum / window. Shorter strings are one window.
    """
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    none = F.array_repeat(F.lit(None).cast("string"), window)
    moves = F.arrays_zip(chars.alias("enters"), F.concat(none, chars).alias("leaves"))

    def weighed(count: Column) -> Column:
        return F.when(count > 0, count * F.log2(count)).otherwise(F.lit(0.0))

    def moved(counts: Column, total: Column, char: Column, by: int) -> Column:
        old = F.coalesce(F.element_at(counts, char), F.lit(0))
        kept = F.map_filter(counts, lambda k, _: k != char)
        return F.struct(
            F.map_concat(kept, F.create_map(char, old + by)).alias("counts"),
            (total + weighed(old + by) - weighed(old)).alias("total"),
        )

    def step(state: Column, move: Column) -> Column:
        added = moved(state["counts"], state["total"], move["enters"], 1)
        left = F.when(
            move["leaves"].isNotNull(), moved(added["counts"], added["total"], move["leaves"], -1)
        ).otherwise(added)
        size = F.least(state["size"] + 1, F.lit(window))
        bits = F.log2(size) - left["total"] / size
        return F.when(move["enters"].isNull(), state).otherwise(F.struct(
            left["counts"].alias("counts"), left["total"].alias("total"), size.alias("size"),
            F.when(size == window, F.greatest(state["best"], bits)).otherwise(bits).alias("best"),
        ))

    begin = F.struct(
        F.create_map().cast("map<string,int>").alias("counts"), F.lit(0.0).alias("total"),
        F.lit(0).alias("size"), F.lit(0.0).alias("best"),
    )
    return F.aggregate(moves, begin, step, lambda state: state["best"])


def wordy(value: Column) -> Column:
    """Whether a candidate is words, also ones joined by signs or capitals: mostly common letter pairs."""
    lower = F.lower(value)
    after = {}
    for first, second in COMMON:
        after[first] = after.get(first, "") + second
    common = F.regexp_count(lower, F.lit("|".join(f"{k}(?=[{v}])" for k, v in after.items())))
    pairs = F.regexp_count(lower, F.lit("[a-z](?=[a-z])"))
    unsigned = F.length(value) - 1 - 2 * F.regexp_count(value, F.lit("[_=/+-]"))
    return (pairs > 0) & (common >= pairs * WORDY) & (pairs >= unsigned * LETTERS)


def entropy_spans(text: Column, allowed: str = ALLOWED) -> Column:
    """Spans of kind entropy: candidates over the threshold of their alphabet, neither allow-listed nor words."""
    candidates = spans_of(
        text, CANDIDATE, "entropy", len(KINDS), text.rlike(CANDIDATE), lambda v: ~v.rlike(allowed)
    )
    def random(s: Column) -> Column:
        least = F.lit(CLASSES[-1][2])
        for _, pattern, bits in reversed(CLASSES[:-1]):
            least = F.when(s["value"].rlike(pattern), bits).otherwise(least)
        coded = s["value"].rlike(CLASSES[0][1]) | s["value"].rlike(CLASSES[1][1])
        return (coded | ~wordy(s["value"])) & (window_entropy(s["value"]) >= least)

    return F.filter(candidates, random)


def secret_spans(docs: DataFrame, text_col: str = "text", spans_name: str = "spans") -> DataFrame:
    """`docs` with an array of spans: base kinds, and entropy spans that overlap none of them.

    Null texts are read as empty; whole texts are read; rows, repeated ones too, and the other
    columns stay; a column called `spans_name` is replaced. Nothing is shuffled.
    """
    text, base, more = fresh(docs, "text", "base", "more")
    rows = docs.withColumn(text, F.coalesce(docs[text_col].cast("string"), F.lit("")))
    rows = rows.withColumns({base: base_spans(F.col(text)), more: entropy_spans(F.col(text))})
    apart = F.filter(
        F.col(more),
        lambda s: ~F.exists(F.col(base), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    kept = [F.col(f"`{c}`") for c in docs.columns if c != spans_name]
    return rows.select(*kept, in_order(F.concat(F.col(base), apart)).alias(spans_name))


def masked(text: Column, spans: Column) -> Column:
    """`text` with every secret given as [SECRET]."""
    return replaced(text, spans, lambda s: F.lit("[SECRET]"))
