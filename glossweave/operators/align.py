"""Alignment of source paragraphs with translations: exact join, then looser keys."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.functions import patterns as P
from glossweave.functions.text import (
    fold, is_blank, signature, strip, strip_leading_label, without_spaces,
)
from glossweave.plans.scan import first_rows
from glossweave.session import MOST_SLICES, slices_of, stored, stored_in_turn

_LABEL_POS = 1 << 40  # labels come behind all segments of a book
_BOOK = 5  # the space of the keys that only say that a book has segments
_KIND_BITS = 44  # places are below 1 << 44
METHODS = {1: "exact", 2: "prefix", 3: "signature", 4: "no_space", 5: "no_label"}


def by_trimmed_source(sources: DataFrame, memory: DataFrame, book: str = "book_id") -> DataFrame:
    """Each source paragraph with the book's first memory entry of equal trimmed text.

    Texts are compared by their hash, so neither side ships them; the result carries the
    trimmed translation (null when no entry exists).
    """
    first = (
        memory.select(
            book, F.md5(strip(F.col("original"))).alias("_key"), "pos",
            strip(F.coalesce("translated", F.lit(""))).alias("target"),
        )
        .groupBy(book, "_key")
        .agg(F.min_by("target", "pos").alias("target"))
    )
    return sources.withColumn("_key", F.md5(strip(F.col("text")))).join(
        first, [book, "_key"], "left"
    ).drop("_key")


def translation_map(segments: DataFrame, labels: bool = True) -> DataFrame:
    """`(book_id, key, first_pos, original, translated)`.

    Keys are folded originals. The place of a key is its first segment, its value the
    last one. Admonition labels are added behind where the book lacks the key.
    """
    filled = segments.where(
        (F.length("original") > 0) & (F.length("translated") > 0)
    ).withColumn("key", fold(F.col("original")))
    entries = (
        filled.groupBy("book_id", "key")
        .agg(
            F.min("pos").cast("long").alias("first_pos"),
            F.max_by(F.struct("original", "translated"), "pos").alias("v"),
        )
        .select("book_id", "key", "first_pos", "v.original", "v.translated")
    )
    if not labels:
        return entries
    # The label list is fixed and tiny: books x 15 rows, not pairs of table rows.
    books = segments.select("book_id").distinct()
    seeded = books.select(
        "book_id",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(en).alias("original"), F.lit(zh).alias("translated"),
                        F.lit(n).alias("nth"),
                    )
                    for n, (en, zh) in enumerate(P.ADMONITIONS.items())
                ]
            )
        ).alias("l"),
    ).select(
        "book_id",
        fold(F.col("l.original")).alias("key"),
        (F.lit(_LABEL_POS) + F.col("l.nth")).alias("first_pos"),
        "l.original",
        "l.translated",
    )
    absent = seeded.join(entries.select("book_id", "key"), ["book_id", "key"], "left_anti")
    return entries.unionByName(absent)


def _hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _pairs(*keys: tuple[int, int, Column]) -> Column:
    """Array of (kind, space, key); a caller explodes it and drops the null keys."""
    return F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(space).alias("space"), k.alias("k")) for kind, space, k in keys
    ])


def _coded(kind: Column, ref: Column) -> Column:
    """Kind and place in one number, which orders by kind first."""
    return F.shiftleft(kind.cast("long"), _KIND_BITS) + ref


def _label_code(folded: Column) -> Column:
    """The code of the fixed label that a text is, whole or but for spaces; null for others.

    Labels are single ASCII words: folding leaves them as they are, they have no leading label
    of their own and are shorter than texts with loose keys.
    """
    names = F.array(*[F.lit(en) for en in P.ADMONITIONS])
    spaced = without_spaces(folded)
    at = F.array_position(names, spaced)
    code = _coded(F.when(folded == spaced, 1).otherwise(4), F.lit(_LABEL_POS) + at - 1)
    return F.when(spaced.isin(*P.ADMONITIONS), code)


def keyed_segments(segments: DataFrame, long_keys: bool = True) -> DataFrame:
    """`(book_id, pos, translated)` with the hashes of each segment's keys; none without a text or an answer.

    Keys: whole, prefix, signature, without spaces, without label. `long_keys=False` leaves prefix
    and signature null. Write the table: texts are folded only once.
    """
    original, key = F.col("original"), F.col("_folded")
    filled = (F.length("original") > 0) & (F.length("translated") > 0)
    none = F.lit(None).cast("binary")
    keys = [
        _hash(key),
        _hash(F.left(key, F.lit(P.PREFIX_CHARS))) if long_keys else none,
        F.when(F.length(original) > P.LOOSE_MIN, _hash(signature(original))) if long_keys else none,
        _hash(without_spaces(key)),
        _hash(without_spaces(strip_leading_label(key))),
    ]
    rows = segments.withColumn("_folded", fold(original))
    return rows.select(
        "book_id", F.col("pos").cast("long").alias("pos"), "translated",
        *[F.when(filled, k).alias(f"k{n}") for n, k in enumerate(keys, 1)],
    )


def alignment_index(keyed: DataFrame) -> DataFrame:
    """`(book_id, space, k, code)`: kind and place of the segment that answers each key of a book.

    Rows are narrow: keys are hashes and places are positions, so no text is shuffled. Of
    equal whole keys the first segment gives the place and the last one the value; of equal
    loose keys the first entry wins, but the last one for signatures. Keys without spaces and
    without label are asked for alike and share a space, where the former win. A row without a
    code says that a book has segments.
    """
    entries = keyed.where(F.col("k1").isNotNull()).groupBy("book_id", "k1").agg(
        F.min("pos").alias("first_pos"),
        F.max("pos").alias("ref"),
        F.min("k2").alias("k2"),
        F.max_by("k3", "pos").alias("k3"),
        F.min("k4").alias("k4"),
        F.min("k5").alias("k5"),
    )
    k1, k2, k3, k4, k5 = (F.col(f"k{n}") for n in range(1, 6))
    pairs = _pairs((1, 1, k1), (2, 2, k2), (3, 3, k3), (4, 4, k4), (5, 4, F.when(k5 != k4, k5)))
    kind, first = F.col("c.kind"), F.col("first_pos")
    rows = (
        entries.select("book_id", "first_pos", "ref", F.explode_outer(pairs).alias("c"))
        .where(F.col("c.k").isNotNull())
        .select(
            "book_id", F.col("c.space").alias("space"), F.col("c.k").alias("k"),
            _coded(kind, F.col("ref")).alias("code"),
            _coded(kind, F.when(kind == 3, -first).otherwise(first)).alias("rank"),
        )
    )
    books = keyed.select("book_id").distinct().select(
        "book_id", F.lit(_BOOK).alias("space"), F.lit(b"").alias("k"),
        F.lit(None).cast("long").alias("code"), F.lit(0).cast("long").alias("rank"),
    )
    return rows.unionByName(books).groupBy("book_id", "space", "k").agg(F.min_by("code", "rank").alias("code"))


def cascade(
    paragraphs: DataFrame, segments: DataFrame, labels: bool = True, long_keys: bool = True
) -> DataFrame:
    """`(book_id, pos, text, translated, align_method)` for every paragraph looked up.

    Tries the folded text, its 80-character prefix, its signature, the text without
    spaces, and keys without their leading label; `long_keys=False` leaves out prefix and
    signature, as for navigation labels. All candidate keys of a paragraph go through one
    narrow join and the best kind wins; texts are joined back by position once. Both tables are
    read once, when this is called, and written, the segments with their keys. Large ones go in turns,
    some books each, so that only the shuffle files of a few books are there at a time.
    """
    stripped = strip(F.col("text"))
    # Texts that fold to one character or less are not looked up.
    asked = paragraphs.select("book_id", "pos", "text").where(
        (F.length(stripped) > 1) | (stripped == "…")
    )
    part = F.pmod(F.xxhash64("book_id"), F.lit(MOST_SLICES)).cast("int").alias("_part")
    texts = stored(asked.select("*", part), "_part")
    keyed = stored(keyed_segments(segments, long_keys).select("*", part), "_part")
    turns = slices_of(texts, keyed)

    def parts() -> Iterator[DataFrame]:
        for n in range(turns):
            mine = list(range(n, MOST_SLICES, turns))
            some = [t.table.where(F.col("_part").isin(mine)).drop("_part") for t in (texts, keyed)]
            yield _cascade(*some, labels, long_keys)
            for t in (texts, keyed):
                for m in mine:
                    t.drop(f"_part={m}")

    return stored_in_turn(asked.sparkSession, parts())


def _cascade(asked: DataFrame, table: DataFrame, labels: bool, long_keys: bool) -> DataFrame:
    folded = F.col("_folded")
    loose = F.lit(long_keys) & (F.length("text") > P.LOOSE_MIN)
    looked = asked.withColumn("_folded", fold(F.col("text"))).select(
        "book_id", "pos",
        _hash(folded).alias("k1"),
        F.when(loose, _hash(F.left(folded, F.lit(P.PREFIX_CHARS)))).alias("k2"),
        F.when(loose, _hash(signature(F.col("text")))).alias("k3"),
        _hash(without_spaces(folded)).alias("k4"),
        (_label_code(folded) if labels else F.lit(None).cast("long")).alias("label"),
    )
    # A label counts in every book with segments, behind those that answer the same key; its
    # key is that of its book, so it takes the path of the others.
    pairs = F.array(
        *[F.struct(F.lit(n).alias("space"), F.col(f"k{n}").alias("k"), F.lit(None).cast("long").alias("label"))
          for n in range(1, 5)],
        F.struct(F.lit(_BOOK).alias("space"), F.when(F.col("label").isNotNull(), F.lit(b"")).alias("k"), F.col("label")),
    )
    found = (
        looked.select("book_id", "pos", F.explode_outer(pairs).alias("c"))
        .where(F.col("c.k").isNotNull())
        .select("book_id", "pos", "c.space", "c.k", "c.label")
        .join(alignment_index(table), ["book_id", "space", "k"])
        .groupBy("book_id", "pos").agg(F.min(F.coalesce("code", "label")).alias("code"))
    )
    values = table.select("book_id", F.col("pos").alias("_ref"), F.col("translated").alias("_said"))
    fixed = F.array(*[F.lit(zh) for zh in P.ADMONITIONS.values()])
    methods = F.create_map(*[F.lit(x) for kv in METHODS.items() for x in kv])
    place = F.col("code").bitwiseAND(F.lit((1 << _KIND_BITS) - 1))
    placed = asked.select("book_id", "pos", "text").join(found, ["book_id", "pos"], "left").withColumn(
        # Unmatched rows get a place of their own that no segment has: a null or shared
        # value would gather them all in one partition.
        "_ref", F.coalesce(place, -1 - F.col("pos"))
    )
    return placed.join(values, ["book_id", "_ref"], "left").select(
        "book_id", "pos", "text",
        F.coalesce("_said", F.get(fixed, (F.col("_ref") - _LABEL_POS).try_cast("int"))).alias(
            "translated"
        ),
        F.coalesce(methods[F.shiftright("code", _KIND_BITS).cast("int")], F.lit("none")).alias("align_method"),
    )


def match_rate(aligned: DataFrame) -> DataFrame:
    """Per book: checked, matched, unmatched, percentage and up to ten unmatched samples."""
    matched = F.col("align_method") != "none"
    counts = aligned.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(matched).alias("matched"),
        F.count_if(~matched).alias("unmatched"),
    )
    samples = (
        first_rows(aligned.where(~matched), ["book_id"], [F.col("pos")], 10)
        .groupBy("book_id")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("pos", F.left("text", F.lit(100)).alias("text")))
            ).alias("s")
        )
        .select("book_id", F.col("s.text").alias("samples"))
    )
    return counts.join(samples, "book_id", "left").select(
        "book_id", "checked", "matched", "unmatched",
        F.round(F.col("matched") * 100.0 / F.col("checked"), 1).alias("match_pct"),
        F.coalesce("samples", F.array().cast("array<string>")).alias("samples"),
    )


def editions(aligned: DataFrame) -> DataFrame:
    """Bilingual and target-only text of each paragraph; the original where unmatched."""
    return aligned.select(
        "book_id",
        "pos",
        F.concat_ws("\n", "text", "translated").alias("bilingual_text"),
        F.coalesce("translated", "text").alias("target_text"),
    )


def translate_labels(aligned: DataFrame) -> DataFrame:
    """Table-of-contents labels: `source / target` and target; unmatched labels stay."""
    return aligned.select(
        "book_id",
        "pos",
        F.concat_ws(" / ", "text", "translated").alias("bilingual_label"),
        F.coalesce("translated", "text").alias("target_label"),
    )
