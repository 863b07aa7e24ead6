"""Cover choice per book from its image members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.sources.containers import IMAGE_ENDINGS

KNOWN_PLACES = ["", "OEBPS/", "OEBPS/images/", "OEBPS/image/"]


def choose(candidates: DataFrame) -> DataFrame:
    """`(book_id, member, size, chosen_by)`.

    Order: the manifest entry the package names, an entry marked `cover-image`, the named
    file in a known place, the largest image (ties by name).
    """
    member = F.col("member")
    is_image = F.lower("member").rlike(r"\.(" + "|".join(e[1:] for e in IMAGE_ENDINGS) + r")\z")
    known = [F.concat(F.lit(p), F.col("meta_cover")) for p in KNOWN_PLACES]
    rank = (
        F.when(F.col("manifest_id") == F.col("meta_cover"), 1)
        .when(F.contains(F.lower(F.coalesce("props", F.lit(""))), F.lit("cover-image")), 2)
    )
    for n, place in enumerate(known):
        rank = rank.when(member == place, 3 + n)
    rank = rank.when(is_image, 9)
    # Within a declared rank the manifest order decides, among images the size.
    nth = F.when(F.col("rank") == 2, F.col("nth")).otherwise(0)
    size = F.when(F.col("rank") == 9, -F.col("size")).otherwise(0)
    names = F.create_map(
        F.lit(1), F.lit("package"), F.lit(2), F.lit("property"), F.lit(9), F.lit("largest")
    )
    return (
        candidates.withColumn("rank", rank)
        .where(F.col("rank").isNotNull())
        .groupBy("book_id")
        .agg(
            F.min(
                F.struct(F.col("rank"), nth.alias("nth"), size.alias("o"), "member", "size")
            ).alias("c")
        )
        .select(
            "book_id", "c.member", "c.size",
            F.coalesce(names[F.col("c.rank")], F.lit("known place")).alias("chosen_by"),
        )
    )
