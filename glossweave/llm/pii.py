"""Personal data: patterns for direct identifiers, co-occurrence for terms that reveal them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.llm.common import cut, fresh, written
from glossweave.llm.spans import SPAN, beside, in_order, replaced, spans_of

KINDS = ("email", "ip", "card", "phone")
#: Each gives the same matches as the plain pattern: a match can only begin where the run of
#: its first characters begins or where the match before it ended, and what is taken
#: greedily never has to be given back. So long runs are read once and need no stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without such a place holds no match of the kind that is kept.
HINTS = {
    "email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]",
}
BYTE = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
#: A plain word: letters that no other character but white space or punctuation touches.
TERM = r"(?<![\p{L}\p{N}@._+-])\p{L}{2,}+(?![\p{L}\p{N}@_+-])"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.split(F.reverse(digits), "")
    value = F.transform(
        F.filter(each, lambda d: d != ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(value, F.lit(0), lambda a, b: a + b) % 10 == 0


def _kept(kind: str):
    def digits(value: Column) -> Column:
        return F.regexp_replace(value, "[^0-9]", "")

    if kind == "ip":
        return lambda v: F.forall(F.split(v, r"\."), lambda part: part.rlike(BYTE))
    if kind == "card":
        return lambda v: F.length(digits(v)).between(12, 19) & luhn(digits(v))
    if kind == "phone":
        return lambda v: F.length(digits(v)).between(9, 15)
    return None


def base_spans(text: Column) -> Column:
    """Spans of all kinds in a text that is not null, by start and then kind."""
    found = []
    for rank, kind in enumerate(KINDS):
        may = text.contains("@") if kind == "email" else text.rlike(HINTS[kind])
        found.append(spans_of(text, PATTERNS[kind], kind, rank, may, _kept(kind)))
    return in_order(F.concat(*found))


def _near_terms(span: Column, reach: int) -> Column:
    """Lower-cased plain words among the `reach` words before and after what beside() gives."""
    both = F.concat(
        F.slice(F.reverse(F.regexp_extract_all(span["before"], F.lit(TERM), F.lit(0))), 1, reach),
        F.slice(F.regexp_extract_all(span["after"], F.lit(TERM), F.lit(0)), 1, reach),
    )
    return F.array_distinct(F.transform(both, lambda w: F.lower(w)))


def disclosing_terms(
    docs: DataFrame,
    reach: int = 5,
    support: int = 3,
    generalise_at: float = 0.7,
    remove_at: float = 0.95,
) -> DataFrame:
    """Columns text_key, term and removed: per text, its terms that give an entity of the corpus away.

    Neighbours are looked for in the 24 * `reach` code points before and after an entity.

    `docs` has text (not null) and spans. An entity is the value of a base span. How much a
    term t reveals of an entity c is their pointwise mutual information over the information
    of the entity, log(p(c,t) / (p(c) p(t))) / -log p(c), which is 1 where t occurs only with
    c. The probabilities are shares of all different texts of the corpus (exact copies count
    once). Terms are plain words within `reach` words of the entity that stand beside it in
    at least `support` different texts; from `generalise_at` on a term is generalised, from
    `remove_at` on removed, the stronger where it reveals several entities, in every text that has it,
    also without the entity. Pairs are counted before their shuffle, word counts cover all
    texts, and no group is gathered.
    """
    key = F.xxhash64("text").alias("text_key")
    held = cut(docs.where(F.size("spans") > 0).select(key, "text", "spans"))
    # A match takes along what stands beside it, never the whole text.
    near = held.select("text_key", F.explode(beside(F.col("text"), F.col("spans"), 24 * reach)).alias("span"))
    terms = F.explode(_near_terms(F.col("span"), reach)).alias("term")
    pairs = cut(near.select(F.xxhash64("span.value").alias("entity"), "text_key", terms).distinct())
    texts = docs.select(F.xxhash64("text")).distinct().count()
    by_text = pairs.select("entity", "text_key").distinct()
    entities = by_text.groupBy("entity").agg(F.count("*").alias("with_entity"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))
    in_held = held.select("text_key", F.explode(words).alias("term")).distinct()
    in_held = in_held.groupBy("term").agg(F.count("*").alias("least_with"))
    information = -F.log(F.col("with_entity") / texts)

    def mutual(with_term: str) -> Column:
        return F.log(F.col("together") * texts / (F.col("with_entity") * F.col(with_term)))

    # A term is in at least as many texts as have both it and an entity, which already rules
    # out the common words before words are counted over all texts.
    joint = pairs.groupBy("entity", "term").agg(F.count("*").alias("together"))
    joint = written(
        joint.where(F.col("together") >= support).join(entities, "entity").join(in_held, "term")
        .where((information > 0) & (mutual("least_with") >= generalise_at * information))
    )
    in_all = cut(
        docs.select(key, F.explode(words).alias("term"))
        .join(joint.select("term").distinct(), "term", "left_semi").distinct()
    )
    counted = in_all.groupBy("term").agg(F.count("*").alias("with_term"))
    found = written(
        joint.join(counted, "term").where(mutual("with_term") >= generalise_at * information)
        .groupBy("term").agg(F.max(mutual("with_term") >= remove_at * information).alias("removed"))
    )
    return in_all.join(found, "term").select("text_key", "term", "removed")


def personal_spans(docs: DataFrame, text_col: str = "text", spans_name: str = "spans", **limits) -> DataFrame:
    """`docs` with an array of spans: base patterns, and terms that reveal what they found.

    Kinds are those of KINDS, term (to be generalised) and gone (to be removed); terms that
    overlap a base span are left out. Null texts are read as empty and have no spans; rows,
    repeated ones too, and all other columns stay as they are, except one that has the name
    `spans_name`, which is replaced. `limits` go to disclosing_terms.
    """
    text, spans, key, terms = fresh(docs, "text", "spans", "text_key", "terms")
    given = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    base = docs.select(given.alias("text")).withColumn("spans", base_spans(F.col("text")))
    revealing = written(
        disclosing_terms(base, **limits).groupBy(F.col("text_key").alias(key)).agg(
            F.collect_list(F.struct("term", "removed")).alias(terms)
        )
    )
    rows = docs.withColumn(text, given).withColumn(spans, base_spans(F.col(text)))
    rows = rows.withColumn(key, F.xxhash64(text)).join(revealing, key, "left")
    found = F.coalesce(
        F.concat(*[_term_spans(F.col(text), F.col(terms), F.col(spans), k) for k in (0, 1)]),
        F.array().cast(f"array<{SPAN}>"),
    )
    whole = F.when(F.col(terms).isNull(), F.col(spans)).otherwise(
        in_order(F.concat(F.col(spans), found))
    )
    kept = [F.col(f"`{c}`") for c in docs.columns if c != spans_name]
    return rows.select(*kept, whole.alias(spans_name))


def _term_spans(text: Column, terms: Column, base: Column, removed: int) -> Column:
    kind = "gone" if removed else "term"
    mine = F.transform(F.filter(terms, lambda t: t["removed"] == bool(removed)), lambda t: t["term"])
    at = spans_of(
        text, TERM, kind, len(KINDS) + removed, F.size(mine) > 0,
        lambda v: F.array_contains(mine, F.lower(v)),
    )
    return F.filter(
        at, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    )


def sanitised(text: Column, spans: Column) -> Column:
    """`text` with base spans and generalised terms as [KIND] and removed terms left out."""
    return replaced(
        text, spans,
        lambda s: F.when(s["kind"] == "gone", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))),
    )
