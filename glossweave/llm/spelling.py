"""Spelling variants: words one edit apart, found by search schemes over bidirectional FM-indexes."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.llm.common import drop_kept, ship, texts, written

RUN = r"[A-Za-zÀ-ÿ]+"
#: States of a search that are worked on side by side.
SIDE = 1 << 18
#: Every this many hashes of an occurrence, one code point of it is dropped.
DROPS = 31


class Index:
    """FM-index of words that each end in a delimiter and are read as circles.

    Rows are all rotations of all delimited words in order; the delimiter, symbol 0, is the least.
    `last` is the symbol before each row (the transform). As every word is a circle of its own, the first
    rows are those that begin with the delimiter, one a word, in the order of the words.
    A pattern's interval of rows grows to the left by one symbol with two look-ups in `places`, the
    rows sorted by their last symbol: the number of smaller entries is the new bound.
    """

    def __init__(self, words: list[np.ndarray]):
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        begins = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        symbols = np.zeros(total, np.int64)
        inside = np.ones(total, bool)
        ends = begins + sizes - 1
        inside[ends] = False
        symbols[inside] = np.concatenate(words) if len(words) else np.zeros(0, np.int64)
        following = np.arange(1, total + 1)
        following[ends] = begins
        before = np.arange(-1, total - 1)
        before[begins] = ends
        rank, step, reach = np.unique(symbols, return_inverse=True)[1], following, 1
        # Doubling: ranks by the first `reach` symbols of a rotation give ranks by twice as many.
        # Two different circles differ within the sum of their sizes.
        while reach < 2 * int(sizes.max(initial=1)):
            rank = np.unique(rank * total + rank[step], return_inverse=True)[1]
            step, reach = step[step], 2 * reach
        row = np.argsort(rank, kind="stable")
        self.rows, self.words = total, len(words)
        self.last = symbols[before[row]]
        self.alphabet = np.unique(self.last)
        self.places = np.sort(self.last * total + np.arange(total), kind="stable")
        #: Word of each of the first rows.
        self.word = np.searchsorted(ends, row[: self.words])

    def extended(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of c + pattern from those of patterns; empty ones have equal bounds."""
        base = symbol * self.rows
        return np.searchsorted(self.places, base + low), np.searchsorted(self.places, base + high)

    def choices(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State numbers and symbols: all symbols but the delimiter that stand before some row of an interval."""
        size = high - low
        few = size <= len(self.alphabet)
        state = np.repeat(np.flatnonzero(few), size[few])
        begin = np.repeat(np.cumsum(size[few]) - size[few], size[few])
        found = self.last[low[state] + np.arange(len(state)) - begin]
        many = np.flatnonzero(~few)
        states = np.concatenate([state, np.repeat(many, len(self.alphabet))])
        symbols = np.concatenate([found, np.tile(self.alphabet, len(many))])
        key = np.unique(states * (1 << 22) + symbols)
        states, symbols = key >> 22, key & ((1 << 22) - 1)
        return states[symbols > 0], symbols[symbols > 0]


def near_words(index: Index, patterns: list[np.ndarray], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (pattern, word of the index) one edit apart that agree in the pattern's first `exact` symbols.

    The index holds the words backwards, so that growing to the left reads them forwards:
    delimiter and exact part first, without error; then the rest, where one symbol may be
    inserted, deleted or replaced; then the delimiter again. Each state is a
    pattern, the number of its symbols that are read, an interval, and whether the error is spent.
    """
    size = np.array([len(p) for p in patterns], np.int64)
    begin = np.cumsum(size) - size
    text = np.concatenate([*patterns, [0]]).astype(np.int64)
    symbol_at = lambda who, at: text[begin[who] + np.minimum(at, size[who] - 1)]
    who = np.arange(len(patterns))
    low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), index.words, np.int64)
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    # States with the error unspent (they all agree with the pattern so far) and with it spent.
    spent = [np.zeros(0, np.int64)] * 4
    for at in range(int(size.max(initial=0)) + 1):
        if len(who):
            free = at >= exact[who]
            states, symbols = index.choices(low[free], high[free])
            mine, from_low, from_high = who[free][states], low[free][states], high[free][states]
            to_low, to_high = index.extended(from_low, from_high, symbols)
            differs = (at >= size[mine]) | (symbol_at(mine, at) != symbols)
            replaced = differs & (at < size[mine])
            dropped = free & (at < size[who])
            made = [
                (mine[differs], np.full(int(differs.sum()), at), to_low[differs], to_high[differs]),
                (mine[replaced], np.full(int(replaced.sum()), at + 1), to_low[replaced], to_high[replaced]),
                (who[dropped], np.full(int(dropped.sum()), at + 1), low[dropped], high[dropped]),
            ]
            spent = [np.concatenate(parts) for parts in zip(spent, *made, strict=True)]
            on = at < size[who]
            who, low, high = who[on], low[on], high[on]
            low, high = index.extended(low, high, symbol_at(who, at))
            who, low, high = who[low < high], low[low < high], high[low < high]
        # States with the error spent read on until their pattern ends in a delimiter or they are empty.
        while len(spent[0]) and (not len(who) or len(spent[0]) > SIDE):
            spent = _read_on(index, symbol_at, size, spent, hits)
    while len(spent[0]):
        spent = _read_on(index, symbol_at, size, spent, hits)
    if not hits:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # One word may be reached by several edits, such as dropping either of two equal letters.
    key = np.unique(np.concatenate([p * index.words + w for p, w in hits]))
    return key // index.words, key % index.words


def _read_on(index: Index, symbol_at: Callable, size: np.ndarray, states: list[np.ndarray], hits: list) -> list[np.ndarray]:
    """One more symbol of each state's pattern; those that reach its end give hits and go."""
    who, at, low, high = states
    over = at >= size[who]
    symbol = np.where(over, 0, symbol_at(who, at))
    low, high = index.extended(low, high, symbol)
    ended = over & (low < high)
    if ended.any():
        hits.append((who[ended], index.word[low[ended]]))
    on = ~over & (low < high)
    return [who[on], at[on] + 1, low[on], high[on]]


def _points(values: list[str]) -> list[np.ndarray]:
    return [np.frombuffer(v.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for v in values]


def _group(table: pa.Table) -> pa.Table:
    """Per asking word of one task: how many words are near, and the best of them.

    Rows are words that are `filed`, that ask, or both. All rows have the same side: at 1 words
    are read backwards, and the exact part is the second half.
    """
    drop_kept()
    side = table.column("side")[0].as_py()
    words, counts = table.column("word").to_pylist(), table.column("n").to_numpy()
    filed, asks = table.column("filed").to_pylist(), table.column("asks").to_pylist()
    count_of = {w: int(n) for w, n, f in zip(words, counts, filed, strict=True) if f}
    held = sorted(count_of)
    asked = sorted({w for w, a in zip(words, asks, strict=True) if a})
    turned = (lambda w: w[::-1]) if side else (lambda w: w)
    half = np.array([len(w) // 2 if not side else len(w) - len(w) // 2 for w in asked], np.int64)
    pattern = other = np.zeros(0, np.int64)
    if held and asked:
        pattern, other = near_words(Index(_points([turned(w)[::-1] for w in held])), _points([turned(w) for w in asked]), half)
    if side:
        # Words that agree in the first half as well were found there.
        fresh = np.array([held[o][: len(asked[p]) // 2] != asked[p][: len(asked[p]) // 2] for p, o in zip(pattern, other, strict=True)], bool)
        pattern, other = pattern[fresh], other[fresh]
    near: dict[int, int] = {}
    best: dict[int, tuple[int, str]] = {}
    for p, o in zip(list(pattern), list(other), strict=True):
        near[p] = near.get(p, 0) + 1
        mine = (-count_of[held[o]], held[o])
        if p not in best or mine < best[p]:
            best[p] = mine
    found = sorted(near)
    return pa.table({
        "word": pa.array([asked[p] for p in found], pa.string()),
        "n_near": pa.array([near[p] for p in found], pa.int64()),
        "near_n": pa.array([-best[p][0] for p in found], pa.int64()),
        "near": pa.array([best[p][1] for p in found], pa.string()),
    })


def _keyed(words: DataFrame) -> DataFrame:
    """Rows side, key, word, n, filed, asks: where a word is filed, and where it asks.

    A word of m letters asks under its first m // 2 letters (side 0) and under the rest (side 1).
    A word near to it has m - 1, m or m + 1 letters, so words are filed under the beginnings and ends
    of the sizes that such words ask for.
    """
    m = F.length("word")
    halves = lambda side: F.transform(
        F.array(m - 1, m, m + 1), lambda x: F.floor(x / 2).cast("int") if not side else (x - F.floor(x / 2)).cast("int")
    )
    out = []
    for side in (0, 1):
        own = F.floor(m / 2).cast("int") if not side else (m - F.floor(m / 2)).cast("int")
        part = lambda size, side=side: F.substring("word", F.lit(1), size) if not side else F.right("word", size)
        rows = words.withColumn("size", F.explode(F.array_distinct(halves(side)))).where(F.col("size").between(0, m))
        out.append(rows.select(
            F.lit(side).alias("side"), part(F.col("size")).alias("key"), "word", "n",
            F.lit(True).alias("filed"), (F.col("size") == own).alias("asks"),
        ))
    return out[0].union(out[1])


def _dealt(rows: DataFrame, task_rows: int) -> DataFrame:
    """`rows` with a column task: a bucket of many keys, or two slices of a key with more than `task_rows` rows.

    In a large key every slice of filed rows meets every slice of asking rows in a task of its
    own; other keys share buckets.
    """
    total = rows.count()
    buckets = max(1, math.ceil(total / task_rows))
    sizes = rows.groupBy("side", "key").agg(F.count("*").alias("rows")).where(F.col("rows") > task_rows)
    large = written(sizes.select("side", "key", F.ceil(F.col("rows") / task_rows).cast("int").alias("slices")))
    marked = rows.join(large, ["side", "key"], "left")
    bucket = F.concat_ws(":", "side", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("string"))
    single = marked.where("slices is null").select("side", "word", "n", "filed", "asks", bucket.alias("task"))
    own = F.pmod(F.xxhash64("word", F.lit(7)), F.col("slices")).cast("int")
    every = F.sequence(F.lit(0), F.col("slices") - 1)
    place = lambda a, b, filed, asks: F.struct(
        F.concat_ws(":", "side", a.cast("string"), b.cast("string"), "key").alias("task"), filed.alias("filed"), asks.alias("asks")
    )
    files = F.transform(every, lambda i: place(own, i, F.lit(True), F.col("asks") & (i == own)))
    asking = F.transform(F.filter(every, lambda i: F.col("asks") & (i != own)), lambda i: place(i, own, F.lit(False), F.lit(True)))
    split = marked.where("slices is not null").select("side", "word", "n", F.explode(F.concat(files, asking)).alias("p"))
    return single.union(split.select("side", "word", "n", "p.filed", "p.asks", "p.task"))


def variants(words: DataFrame, ratio: int = 10, task_rows: int = 20_000) -> DataFrame:
    """Adds n_near, form, form_n and root to rows word (distinct), n.

    Words are near if they differ by one inserted, deleted or replaced code point; n_near counts
    them. The form of a word is its near word with the largest n, ties to the smallest in code-point order, if
    that n is at least `ratio` (> 1) times the word's own, and root is where following forms ends.

    One error leaves one half of a word whole. Words meet under that half, in buckets of many halves or
    in slices of a frequent one, so that no task holds more than some `task_rows` words of either kind. A task
    builds an FM-index of its words and searches it with each half matched exactly and one error
    in the other; pairs found by both halves count with the first. Forms chain to larger and larger
    counts, so log2 of the longest possible chain rounds of joining finish the roots.
    """
    ship(words.sparkSession)
    rows = written(_dealt(_keyed(words), task_rows))
    found = rows.groupBy("task").applyInArrow(_group, "word string, n_near long, near_n long, near string")
    near = found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
    )
    joined = words.join(near, "word", "left")
    has_form = -F.col("best.minus") >= F.col("n") * ratio
    out = written(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has_form, F.col("best.near")).alias("form"), F.when(has_form, -F.col("best.minus")).alias("form_n"),
    ))
    most = out.agg(F.max("n")).first()[0] or 1
    roots = out.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(1, math.log(most, ratio)))))):
        after = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = written(roots.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return out.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _worn(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows run, c, h: the lower-cased runs of each document, how often, and the hash of id and run."""
    lower = F.translate(F.col("run"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    name = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), lower)
    runs = docs.select(F.col(id_col), F.explode(F.regexp_extract_all(texts(docs, text_col), F.lit(RUN), F.lit(0))).alias("run"))
    return runs.select(lower.alias("run"), F.crc32(F.encode(name, "utf-8")).alias("h"))


def _dropped(run: Column, h: Column) -> Column:
    """The run without its code point h % length, if the hash says so."""
    at = F.pmod(h, F.length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % DROPS == 0, shorter).otherwise(run)


def spelled_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, least: int = 2
) -> DataFrame:
    """Columns word and n: words of at least `shortest` code points with at least `least` occurrences.

    Words are the runs [A-Za-z\\u00C0-\\u00FF]+ of whole texts with A-Z in lower case. Where the
    unsigned crc32 of `<id>:<run>` is a multiple of 31, the run's code point at crc32 modulo
    its length is dropped. Null texts have no words, a null id reads as empty, repeated rows count
    each, other columns are not read.
    """
    rows = _worn(docs, id_col, text_col).where(F.length("run") >= shortest)
    words = rows.select(_dropped(F.col("run"), F.col("h")).alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = 10) -> DataFrame:
    """variants() of spelled_words(); an empty table, or one without such words, gives an empty result."""
    return variants(written(spelled_words(docs, id_col, text_col)), ratio)
