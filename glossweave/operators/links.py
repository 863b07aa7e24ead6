"""Share links matched to books by fuzzy title similarity."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType

from glossweave.functions.names import link_words
from glossweave.functions.ratios import MOST_FIRST, MOST_SECOND, Pairs
from glossweave.functions.similarity import CONTAINED, matching_ratio
from glossweave.functions.text import strip
from glossweave.session import cut, spread, written

MIN_SCORE = 0.5
#: Texts of at least so many letters are looked for by a part of that length.
GRAM = 6
SLICE_LINKS = 5_000
SLICE_TITLES = 20_000
#: Bands of titles: lengths grow by this factor from one to the next, and the shares of
#: BAND_GROUPS groups of letters are told apart in steps of 1 / BAND_STEPS.
BAND_GROWTH = 1.2
BAND_GROUPS = 3
BAND_STEPS = 8
#: Letters are counted in so many groups, by code point.
LETTER_GROUPS = 32
_FOUND = "link_key string, score double, created_seq long, book_id long"


class _Letters:
    """Letter counts of strings: an upper bound of their matching ratio."""

    WIDTH = 64

    def __init__(self, texts: list[str]):
        self.lengths = np.array([len(t) for t in texts], dtype=np.int32)
        self.counts = np.zeros((len(texts), self.WIDTH), dtype=np.int16)
        for row, text in enumerate(texts):
            np.add.at(self.counts[row], [ord(c) % self.WIDTH for c in text], 1)

    def bounds(self, counts: np.ndarray, length: int) -> np.ndarray:
        """No matching can use more letters than both strings hold."""
        shared = np.minimum(self.counts, counts).sum(axis=1)
        total = self.lengths + length
        return np.divide(2.0 * shared, total, out=np.ones(len(total)), where=total > 0)


def _common_length(places: dict[str, int], full: int, title: str) -> int:
    """Length of the longest common subsequence, one bit per letter of the link.

    The matching blocks of a ratio are a common subsequence, so this bounds it.
    """
    rest = full
    for letter in title:
        hit = rest & places.get(letter, 0)
        rest = ((rest + hit) | (rest - hit)) & full
    return full.bit_count() - rest.bit_count()


def _best_in(
    link: str, link_counts: np.ndarray, titles: list[str], letters: _Letters, floor: float,
    ranks: list[int],
) -> tuple[float, int] | None:
    """Best fuzzy title for one link: highest score, then first by `ranks`."""
    best, at = 0.0, -1
    bounds = letters.bounds(link_counts, len(link))
    places: dict[str, int] = {}
    for n, letter in enumerate(link):
        places[letter] = places.get(letter, 0) | 1 << n
    full = (1 << len(link)) - 1
    for n in np.argsort(-bounds, kind="stable"):
        bound = bounds[n]
        if bound < best or bound < floor:
            break
        title = titles[n]
        # Containment scores by rule, whatever the ratio is.
        if title in link or link in title:
            continue
        shared = _common_length(places, full, title)
        if 2.0 * shared / (len(link) + len(title)) < max(best, floor):
            continue
        # The first argument is the link, as the ratio is not symmetric.
        score = SequenceMatcher(None, link, title).ratio()
        if score > best or (score == best and at >= 0 and ranks[n] < ranks[at]):
            best, at = score, int(n)
    return (best, at) if at >= 0 and best >= floor else None


def _best_of_short(links: list[str], titles: list[str], floors: list[float]) -> dict[int, tuple[float, int]]:
    """Best fuzzy title by place of each link, of equal scores the first title; texts of bounded length."""
    pairs, floor = Pairs(links, titles), np.array(floors, dtype=np.float64)
    at, to, bound = pairs.reaching(floor)
    # Containment scores by rule, whatever the ratio is.
    fuzzy = np.array([titles[t] not in links[n] and links[n] not in titles[t] for n, t in zip(at, to)], dtype=bool)
    at, to, bound = at[fuzzy], to[fuzzy], bound[fuzzy]
    # The score of each link's most promising title is a floor for the others.
    order = np.lexsort((to, -bound, at))
    at, to, bound = at[order], to[order], bound[order]
    head = np.diff(at, prepend=-1) > 0
    np.maximum.at(floor, at[head], pairs.ratios(at[head], to[head]))
    left = bound >= floor[at]
    at, to = at[left], to[left]
    score = pairs.ratios(at, to)
    good = score >= floor[at]
    best: dict[int, tuple[float, int]] = {}
    for n, t, s in zip(at[good].tolist(), to[good].tolist(), score[good].tolist()):
        if n not in best or (s, -t) > (best[n][0], -best[n][1]):
            best[n] = (s, t)
    return best


def _match_cell(links: pd.DataFrame, titles: pd.DataFrame) -> pd.DataFrame:
    """Best title per link inside one cell, at least as good as the link's floor.

    Short texts are compared side by side; what `Pairs` has no room for, one by one.
    """
    titles = titles.sort_values(["created_seq", "book_id"], ascending=[False, True], kind="stable")
    keys = titles["title_key"].tolist()
    ids, seqs = titles["book_id"].tolist(), titles["created_seq"].tolist()
    wanted, floors = links["link_key"].tolist(), links["floor"].tolist()
    short = [n for n, t in enumerate(keys) if len(t) <= MOST_SECOND]
    narrow = [n for n, t in enumerate(wanted) if len(t) <= MOST_FIRST]
    found = _best_of_short([wanted[n] for n in narrow], [keys[n] for n in short], [floors[n] for n in narrow])
    best = {narrow[n]: (score, short[at]) for n, (score, at) in found.items()}

    def compare(some: list[int], among: list[int]) -> None:
        if not some or not among:
            return
        letters, own = _Letters([keys[t] for t in among]), _Letters([wanted[n] for n in some])
        ranks = list(range(len(among)))
        for row, n in enumerate(some):
            floor = max(floors[n], best[n][0]) if n in best else floors[n]
            one = _best_in(wanted[n], own.counts[row], [keys[t] for t in among], letters, floor, ranks)
            if one and (n not in best or (one[0], -among[one[1]]) > (best[n][0], -best[n][1])):
                best[n] = (one[0], among[one[1]])

    compare([n for n, t in enumerate(wanted) if len(t) > MOST_FIRST], list(range(len(keys))))
    compare(narrow, [n for n, t in enumerate(keys) if len(t) > MOST_SECOND])
    rows = [(wanted[n], score, seqs[at], ids[at]) for n, (score, at) in sorted(best.items())]
    return pd.DataFrame(rows, columns=["link_key", "score", "created_seq", "book_id"])


@pandas_udf(ArrayType(IntegerType()))
def _letter_counts(texts: pd.Series) -> pd.Series:
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    return pd.Series([np.bincount(c % LETTER_GROUPS, minlength=LETTER_GROUPS) for c in codes])


def _parts(text: Column, size: Column | int) -> Column:
    """The parts of `size` letters of a text that has as many."""
    size = F.lit(size) if isinstance(size, int) else size
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.transform(starts, lambda at: F.substring(text, at, size))


def _small_parts(text: Column) -> Column:
    """All different parts of fewer than GRAM letters, the empty one too."""
    sizes = F.sequence(F.lit(0), F.least(F.lit(GRAM - 1), F.length(text)))
    return F.array_distinct(F.flatten(F.transform(sizes, lambda size: _parts(text, size))))


def _inside(inner: DataFrame, inner_key: str, outer: DataFrame, outer_key: str) -> DataFrame:
    """Pairs of different texts, the first (of GRAM letters at least) a part of the second.

    The key of an inner text is that of its grams which the fewest outer texts have. Rows of
    grams hold no texts, only hashes of them: a text in each would be pressed so small in the
    shuffle that the size rule put far too many rows into a task. Grams are told by 32-bit
    hashes: equal hashes of different grams only add pairs to be checked. Count and hash are
    one whole number, whose least is found without sorting.
    """

    def mark(key: str) -> Column:
        return F.unhex(F.md5(key))

    def grams(df: DataFrame, key: str, name: str) -> DataFrame:
        long = spread(df.select(key).where(F.length(key) >= GRAM), key)
        hashed = F.array_distinct(F.transform(_parts(F.col(key), GRAM), lambda part: F.hash(part)))
        return long.select(mark(key).alias(name), F.explode(hashed).alias("_gram"))

    held = spread(grams(outer, outer_key, "_outer"), "_gram")
    often = held.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    count = F.least(F.coalesce("_n", F.lit(0)), F.lit(2**31 - 1))
    rarest = (
        spread(grams(inner, inner_key, "_inner"), "_gram")
        .join(often, "_gram", "left")
        .groupBy("_inner")
        .agg(F.min(F.shiftleft(count, 32) + F.col("_gram") + F.lit(2**31)).alias("_least"))
        .select("_inner", (F.col("_least").bitwiseAND(F.lit(2**32 - 1)) - F.lit(2**31)).cast("int").alias("_gram"))
    )
    met = rarest.join(held, "_gram").select("_inner", "_outer")
    pairs = met.join(inner.select(mark(inner_key).alias("_inner"), inner_key), "_inner").join(
        outer.select(mark(outer_key).alias("_outer"), outer_key), "_outer"
    )
    return pairs.where(F.contains(outer_key, inner_key)).select(inner_key, outer_key)


def _best(found: DataFrame, key: str) -> DataFrame:
    """Of each key the highest score, then the newest book, then the smallest id."""
    order = F.struct("score", "created_seq", -F.col("book_id"))
    winner = F.max_by(F.struct("score", "created_seq", "book_id"), order)
    return found.groupBy(key).agg(winner.alias("_w")).select(key, "_w.*")


def keyed_matches(keyed: DataFrame, newest: DataFrame) -> DataFrame:
    """Best equal or containing or contained title per key: `(link_key, score, …)`.

    Equal texts meet by key. A text of fewer than GRAM
    letters meets the small parts of the others. Longer texts meet by their rarest gram.
    """
    wanted = keyed.select("link_key").distinct()
    contained = [F.lit(CONTAINED).alias("score"), "created_seq", "book_id"]
    equal = wanted.join(newest, F.col("link_key") == F.col("title_key")).select(
        "link_key", F.lit(1.0).alias("score"), "created_seq", "book_id"
    )
    # Both tables are small where texts are long; then no part is shuffled.
    short_titles = written(newest.where(F.length("title_key") < GRAM))
    short_links = written(wanted.where(F.length("link_key") < GRAM))
    small_titles = (
        spread(wanted, "link_key")
        .select("link_key", F.explode(_small_parts(F.col("link_key"))).alias("title_key"))
        .join(short_titles, "title_key")
        .select("link_key", *contained)
    )
    titles_in = (
        _inside(newest, "title_key", wanted, "link_key")
        .join(newest, "title_key")
        .select("link_key", *contained)
    )
    small_links = (
        spread(newest, "title_key")
        .select(F.explode(_small_parts(F.col("title_key"))).alias("link_key"), *contained)
        .join(short_links, "link_key")
        .select("link_key", "score", "created_seq", "book_id")
    )
    links_in = (
        _inside(wanted, "link_key", newest, "title_key")
        .join(newest, "title_key")
        .select("link_key", *contained)
    )
    found = equal.unionByName(small_titles).unionByName(titles_in)
    return _best(found.unionByName(small_links).unionByName(links_in), "link_key")


def _seeds(wanted: DataFrame, newest: DataFrame) -> DataFrame:
    """The score of one promising title per link: `(link_key, seed)`.

    Each gram of the titles stands for two of them (by number, so that the aggregate holds no
    text); of those that a link's grams name, the one named most often is scored. It is a real
    score of a real title, so the best one can't be lower, whichever title was picked.
    """

    def grams(df: DataFrame, key: str, *more: str) -> DataFrame:
        long = df.where(F.length(key) >= GRAM)
        return long.select(*more, F.explode(F.array_distinct(_parts(F.col(key), GRAM))).alias("_gram"))

    named = grams(newest, "title_key", "book_id").groupBy("_gram").agg(
        F.min("book_id").alias("_lo"), F.max("book_id").alias("_hi")
    )
    picked = (
        grams(wanted, "link_key", "link_key")
        .join(named, "_gram")
        .select("link_key", F.explode(F.array_distinct(F.array("_lo", "_hi"))).alias("book_id"))
        .groupBy("link_key", "book_id")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("link_key")
        .agg(F.max_by("book_id", F.struct("_n", "book_id")).alias("book_id"))
    )
    link, title = F.col("link_key"), F.col("title_key")
    held = F.contains(link, title) | F.contains(title, link)
    score = F.when(held, F.lit(CONTAINED)).otherwise(matching_ratio(link, title))
    scored = picked.join(newest, "book_id").select("link_key", score.alias("seed"))
    return scored.groupBy("link_key").agg(F.max("seed").alias("seed"))


def _counted(df: DataFrame, key: str) -> DataFrame:
    """Texts that have letters, with their length and counts of letters by group."""
    return df.where(F.length(key) > 0).select(
        "*", F.length(key).alias("_length"), _letter_counts(F.col(key)).alias("_counts")
    )


def _length_band(length: Column) -> Column:
    return F.floor(F.log(length) / F.log(F.lit(BAND_GROWTH))).cast("int")


def _banded(newest: DataFrame) -> DataFrame:
    """Titles with their band: one whole number made of a length band and letter shares."""
    titles = _counted(newest, "title_key")
    band = _length_band(F.col("_length")).cast("long")
    for group in range(BAND_GROUPS):
        own = [F.element_at("_counts", g + 1) for g in range(group, LETTER_GROUPS, BAND_GROUPS)]
        share = F.floor(sum(own[1:], own[0]) * BAND_STEPS / F.col("_length"))
        band = band * (BAND_STEPS + 1) + share
    return titles.withColumn("band", band).withColumn("_long", _length_band(F.col("_length")))


def _bands(titles: DataFrame, slice_titles: int) -> DataFrame:
    """A row per band: how many titles, their shortest, and the most of each letter group."""
    most = [F.max(F.element_at("_counts", g + 1)) for g in range(LETTER_GROUPS)]
    return titles.groupBy("_long", "band").agg(
        F.count(F.lit(1)).alias("titles"),
        F.min("_length").alias("_shortest"),
        F.array(*most).alias("_most"),
    ).withColumn("_cols", F.ceil(F.col("titles") / slice_titles).cast("int"))


def reachable_bands(
    wanted: DataFrame, titles: DataFrame, slice_titles: int = SLICE_TITLES
) -> DataFrame:
    """Bands that may hold a title as good as a link's floor: `(link_key, floor, band, …)`.

    `wanted` holds `(link_key, floor)`, `titles` comes from `_banded`. Twice the letters that
    link and band can share, over the least sum of lengths, is no less than any ratio in the
    band. Lengths alone leave a range of length bands, which is the key of the join. The table
    of bands is small whatever the data: no more than 118 lengths (strings end at 2^31) times
    (BAND_STEPS + 1) ** BAND_GROUPS, some 86 000 rows at the very most, so it is sent to all.
    """
    links = _counted(wanted, "link_key")
    floor, length = F.col("floor"), F.col("_length")
    # Float rounding may put a border off by one; a band more on both sides is harmless.
    first = F.greatest(_length_band(F.greatest(length * floor / (2 - floor), F.lit(1.0))) - 1, F.lit(0))
    last = _length_band(length * (2 - floor) / floor) + 1
    near = links.select("*", F.explode(F.sequence(first, last)).alias("_long"))
    met = near.join(F.broadcast(_bands(titles, slice_titles)), "_long")
    least = F.zip_with("_counts", "_most", lambda a, b: F.least(a, b))
    shared = F.aggregate(least, F.lit(0), lambda total, n: total + n)
    bound = F.lit(2.0) * shared / (length + F.col("_shortest"))
    return met.withColumn("bound", bound).where(F.col("bound") >= floor).select(
        "link_key", "floor", "band", "bound", "titles", "_cols"
    )


def _fuzzy_matches(
    wanted: DataFrame, newest: DataFrame, slice_links: int, slice_titles: int
) -> DataFrame:
    """Best title of every cell: a band's titles and the links that may find one there.

    Bands with many titles or links are cut into slices of bounded size that all meet.
    """
    titles = _banded(newest)
    met = cut(reachable_bands(wanted, titles, slice_titles))
    # One row per band, which is bounded as in `reachable_bands`.
    grid = met.groupBy("band").agg(
        F.ceil(F.count(F.lit(1)) / slice_links).cast("int").alias("_rows"), F.max("_cols").alias("_cols")
    )

    def slice_of(key: str, slices: Column) -> Column:
        return F.pmod(F.xxhash64(key), slices).cast("int")

    def all_of(slices: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), slices - 1))

    rows, cols = F.col("_rows"), F.col("_cols")
    left = met.drop("_cols").join(F.broadcast(grid), "band").select(
        "band", "link_key", "floor", slice_of("link_key", rows).alias("_row"), all_of(cols).alias("_col")
    )
    right = titles.select("band", "title_key", "book_id", "created_seq").join(F.broadcast(grid), "band").select(
        "band", "title_key", "book_id", "created_seq",
        slice_of("title_key", cols).alias("_col"), all_of(rows).alias("_row"),
    )
    cell = ["band", "_row", "_col"]
    # Cells are few bytes and much work, so the size rule must not merge them into few tasks.
    left, right = spread(left, *cell), spread(right, *cell)
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(_match_cell, _FOUND)


def _newest(books: DataFrame) -> DataFrame:
    """Completed books by folded title, of equal titles the newest: `(title_key, book_id, …)`."""
    titled = books.where(F.col("status") == "completed").select(
        "book_id", "created_seq", F.lower(F.coalesce("title", F.lit(""))).alias("title_key")
    ).withColumn("title_key", strip(F.col("title_key")))
    return titled.groupBy("title_key").agg(
        F.max_by("book_id", F.struct("created_seq", -F.col("book_id"))).alias("book_id"),
        F.max("created_seq").alias("created_seq"),
    )


def _floors(keyed: DataFrame, newest: DataFrame, found: DataFrame, floor: float) -> DataFrame:
    """What a fuzzy title must reach for each link without an equal one: `(link_key, floor)`.

    That is the best score known without comparing all: of a keyed match or of a seed.
    """
    unequal = keyed.select("link_key").distinct().join(
        newest, F.col("link_key") == F.col("title_key"), "left_anti"
    )
    known = found.select("link_key", F.col("score").alias("_keyed"))
    return (
        unequal.join(known, "link_key", "left")
        .join(_seeds(unequal, newest), "link_key", "left")
        .select("link_key", F.greatest(F.lit(floor), "_keyed", "seed").alias("floor"))
    )


def match_links(
    links: DataFrame, books: DataFrame, floor: float = MIN_SCORE, fuzzy: bool = True,
    slice_links: int = SLICE_LINKS, slice_titles: int = SLICE_TITLES,
) -> DataFrame:
    """Best completed book per link: `(links.*, score, book_id, title)`.

    `links` holds `(link_id, filename)`; `floor` is above 0. Equality and containment are found
    by keys (see `keyed_matches`); `fuzzy=False` stops there. For the rest equal links fold
    into one, equal titles into their newest book. Titles are filed in bands by length and
    letter shares; a link meets the bands whose upper bound reaches the best score it has
    already, from a keyed match or from one promising title, and by an equi-join on the band.
    Inside a cell of bounded size upper bounds skip most ratios. Nothing that could win is
    left out. Links without a good title still meet many bands: their floor rules out little.
    """
    newest = written(_newest(books))
    keyed = links.where(F.length(F.coalesce("filename", F.lit(""))) > 0).select(
        "link_id", link_words(F.col("filename")).alias("link_key")
    )
    wanted = written(keyed.select("link_key").distinct())
    found = keyed_matches(wanted, newest)
    if fuzzy:
        # Read by the floors and by the choice at the end.
        found = cut(found)
        floors = _floors(wanted, newest, found, floor)
        found = found.unionByName(_fuzzy_matches(floors, newest, slice_links, slice_titles))
    best = _best(found.where(F.col("score") >= floor), "link_key")
    best = keyed.join(best, "link_key").select("link_id", "book_id", "score")
    titles = books.select("book_id", "title")
    return links.join(best.join(titles, "book_id"), "link_id", "left")


def link_report(matched: DataFrame) -> DataFrame:
    return matched.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("book_id").isNotNull()).alias("matched"),
        F.count_if(F.col("book_id").isNull()).alias("unmatched"),
    )


def link_changes(matched: DataFrame) -> DataFrame:
    """Column changes for `catalog.upsert_outputs`; rows without a URL change nothing.

    `matched` holds `(link_id, book_id, share_url, extract_code)`; both offers get the
    same URL.
    """
    usable = matched.where(
        F.col("book_id").isNotNull() & (F.length(F.coalesce("share_url", F.lit(""))) > 0)
    )
    pairs = F.array(
        F.struct(F.lit("pan_link_sku1").alias("column"), F.col("share_url").alias("value")),
        F.struct(F.lit("pan_link_sku2").alias("column"), F.col("share_url").alias("value")),
        F.struct(F.lit("pan_code").alias("column"), F.col("extract_code").alias("value")),
    )
    return usable.select(
        "book_id", F.col("link_id").alias("seq"), F.explode(pairs).alias("c")
    ).select("book_id", "seq", "c.column", "c.value")
