"""Phrases and their collocation scores by dynamic itemset counting over shards of the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossweave.llm.common import drop_kept, present, removed, ship, texts, written, written_path

#: Bytes of text that are counted together in a task.
STRETCH_BYTES = 8 << 20
#: Slots of the filter; a phrase sets three of them.
FILTER_SLOTS = 1 << 22
#: Words of a text that is put together from runs of words.
RUN_WORDS = 1024
UNKNOWN = "und"

WORD, SPACE, BREAK = 0, 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = SPACE
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = BREAK
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

COUNTS = "lang string, phrase string, len int, h long, c long"
STATE = "lang string, phrase string, len int, h long, c long, since int, reach int"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * MULTIPLIER
    return h ^ (h >> np.uint64(32))


def _hashes(values: list[str]) -> np.ndarray:
    return hash_array(np.array(values, object), categorize=False)


def word_hashes(words: pa.StringArray) -> np.ndarray:
    """Hashes of words, none of them empty, all at once: polynomials of their bytes."""
    if not len(words):
        return np.zeros(0, np.uint64)
    _, offsets, data = words.buffers()
    bounds = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1]
    values = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]].astype(np.uint64) + np.uint64(1)
    begins, sizes = bounds[:-1] - bounds[0], np.diff(bounds)
    powers = np.cumprod(np.full(sizes.max(), MULTIPLIER))
    values *= powers[np.arange(len(values), dtype=np.int32) - np.repeat(begins, sizes)]
    return _mixed(np.add.reduceat(values, begins))


def longer_by(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word; those of no words are the hashes of their languages."""
    return _mixed(hashes * MULTIPLIER ^ words)


def slots(hashes: np.ndarray, size: int) -> np.ndarray:
    """Three slots of each hash, a row per hash."""
    step = _mixed(hashes) | np.uint64(1)
    return np.stack([(hashes + np.uint64(n) * step) % np.uint64(size) for n in range(3)], axis=1).astype(np.int64)


def marked_in(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Bit t is set if the phrase may have been marked in step t; never unset wrongly."""
    at = slots(hashes, len(table))
    return table[at[:, 0]] & table[at[:, 1]] & table[at[:, 2]]


class Words:
    """The words of a stretch of texts: numbers of words, languages, and who stands beside whom."""

    def __init__(self, data: np.ndarray, begins: np.ndarray, languages: np.ndarray):
        kind = KIND[data]
        is_word = kind == WORD
        first = is_word.copy()
        first[1:] &= ~is_word[:-1]
        begins, languages = begins[begins < len(data)], languages[begins < len(data)]
        first[begins] |= is_word[begins]
        at = np.flatnonzero(first)
        self.size = len(at)
        ends = np.cumsum(is_word, dtype=np.int32)
        offsets = np.append(ends[at] - 1, ends[-1] if len(ends) else 0).astype(np.int32)
        values = pa.StringArray.from_buffers(
            self.size, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(LOWER[data[is_word]]))
        )
        coded = values.dictionary_encode()
        self.words, self.code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        held = np.diff(np.append(np.searchsorted(at, begins), self.size))
        text = np.repeat(np.arange(len(begins)), held)
        self.language = np.repeat(languages, held)
        breaks = np.cumsum(kind == BREAK, dtype=np.int32)[at]
        # beside[i]: words i and i + 1 stand in one piece of one text.
        self.beside = np.append((breaks[1:] == breaks[:-1]) & (text[1:] == text[:-1]), False)[: self.size]


def _known(
    found: Words, names: list[str], reached: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each language's words: the word, language and count of each, its hash and bits in `reached`, and
    which of them stands at each place; and the hashes of words alone."""
    many = len(found.words)
    word_hash = word_hashes(found.words)
    key, size = found.language * many + found.code, len(names) * many
    if size <= 8 * found.size:
        total = np.bincount(key, minlength=size)
        at = present = np.flatnonzero(total)
        count = total[present]
    else:
        present, key, count = np.unique(key, return_inverse=True, return_counts=True)
        at, size = np.arange(len(present)), len(present)
    language, word = present // many, present % many
    made = longer_by(_hashes(names)[language], word_hash[word])
    hash_of, bits_of = np.zeros(size, np.uint64), np.zeros(size, np.uint32)
    hash_of[at], bits_of[at] = made, marked_in(reached, made)
    return word, language, count, hash_of[at], hash_of[key], bits_of[key], word_hash


def _longer(
    found: Words, positions: np.ndarray | None, bits: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases with one more word both of whose subphrases have bits: their places among those given, where they
    begin, and their bits. `positions` are the places of the phrases of `bits` (None: each word)."""
    beside = found.beside[:-1] if positions is None else positions[1:] == positions[:-1] + 1
    good = np.flatnonzero(beside & (bits[:-1] != 0) & (bits[1:] != 0))
    return good, good if positions is None else positions[good], bits[good] | bits[good + 1]


def counted(
    found: Words, names: list[str], longest: int, step: int, shards: int, reached: np.ndarray, active: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """Rows of COUNTS for one stretch of the shard of this step.

    Words are counted in the first cycle. A longer phrase both of whose subphrases reached the threshold
    less than a cycle ago is counted by its hash alone, and one that was activated less than a
    cycle ago by its text, both as far as the filters can tell.
    """
    if not found.size:
        return
    name_array = pa.array(names, pa.string())
    last_open = np.uint32(max(0, step - shards))

    def batch(language, phrase, length: int, hashes, count) -> pa.RecordBatch:
        size = len(count)
        return pa.RecordBatch.from_arrays(
            [pa.nulls(size, pa.string()) if language is None else name_array.take(pa.array(language)),
             pa.nulls(size, pa.string()) if phrase is None else phrase.cast(pa.string()),
             pa.nulls(size, pa.int32()) if phrase is None else pa.array(np.full(size, length), pa.int32()),
             pa.nulls(size, pa.int64()) if hashes is None else pa.array(hashes.view(np.int64)), pa.array(count, pa.int64())],
            ["lang", "phrase", "len", "h", "c"],
        )

    word, language, count, own_hash, hashes, bits, word_hash = _known(found, names, reached)
    if step < shards:
        yield batch(language, found.words.take(pa.array(word)), 1, own_hash, count)
        total = np.bincount(found.language, minlength=len(names))
        yield batch(np.flatnonzero(total), pa.array([""] * int((total > 0).sum())), 0, None, total[total > 0])
    positions = None
    for length in range(2, longest + 1):
        # bits and hashes are those of the phrases one word shorter that begin at `positions`.
        good, positions, either = _longer(found, positions, bits)
        if not len(good):
            return
        hashes = longer_by(hashes[good], word_hash[found.code[positions + length - 1]])
        eligible = (either >> last_open) != 0
        if eligible.any():
            values, count = np.unique(hashes[eligible], return_counts=True)
            yield batch(None, None, length, values, count)
        running = np.flatnonzero((marked_in(active, hashes) >> last_open) != 0)
        if len(running):
            begin = positions[running]
            text = pc.binary_join_element_wise(*[found.words.take(pa.array(found.code[begin + k])) for k in range(length)], " ")
            rows = pa.table({"lang": found.language[begin], "phrase": text, "h": hashes[running]})
            rows = rows.group_by(["lang", "phrase", "h"]).aggregate([([], "count_all")]).combine_chunks()
            column = lambda n: rows.column(n).to_numpy()  # noqa: E731, B023
            yield batch(column("lang"), rows.column("phrase").chunk(0), length, column("h"), column("count_all"))
        if length < longest:
            bits = marked_in(reached, hashes)


def frequent_runs(
    found: Words, names: list[str], settled: int, reached: np.ndarray, most: int = RUN_WORDS
) -> Iterator[pa.RecordBatch]:
    """Rows lang, text with all that phrases of more than `settled` words can still be made of.

    Once all phrases of up to `settled` words are counted, a longer one can reach the threshold only where all
    its phrases of `settled` words have. Runs of words in which they have, as far as the filter can tell,
    are kept whole and in order, and stand in pieces of their own; runs of one language share texts of about `most` words.
    """
    if not found.size:
        return
    *_, hashes, bits, word_hash = _known(found, names, reached)
    positions = None
    for length in range(2, settled + 2):
        good, positions, _ = _longer(found, positions, bits)
        if not len(good):
            return
        if length <= settled:
            hashes = longer_by(hashes[good], word_hash[found.code[positions + length - 1]])
            bits = marked_in(reached, hashes)
    kept = np.zeros(found.size, bool)
    for k in range(settled + 1):
        kept[positions + k] = True
    at = np.flatnonzero(kept)
    at = at[np.argsort(found.language[at], kind="stable")]
    goes_on = found.beside[at] & (np.append(at[1:], -1) == at + 1)
    joined = pc.binary_join_element_wise(
        found.words.take(pa.array(found.code[at])), pa.array(["\n", " "]).take(pa.array(goes_on.astype(np.int8))), ""
    )
    ends = np.flatnonzero(~goes_on)
    language, number = found.language[at[ends]], ends // most
    last = ends[np.append((language[1:] != language[:-1]) | (number[1:] != number[:-1]), True)]
    _, offsets, data = joined.buffers()
    begins = np.frombuffer(offsets, np.int32)[np.append(0, last + 1)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()).take(pa.array(found.language[at[last]])),
         pa.StringArray.from_buffers(len(last), pa.py_buffer(begins), data)], ["lang", "text"],
    )


def _stretches(batches: Iterator[pa.RecordBatch], most: int = STRETCH_BYTES) -> Iterator[tuple[Words, list[str]]]:
    """Words of about `most` bytes of text; a longer text is cut where a piece ends."""
    held: list[tuple[np.ndarray, str]] = []
    size = 0

    def made() -> tuple[Words, list[str]]:
        names = sorted({name for _, name in held})
        number = {name: n for n, name in enumerate(names)}
        begins = np.cumsum([0, *(len(d) for d, _ in held)])[:-1]
        return Words(np.concatenate([d for d, _ in held]), begins, np.array([number[n] for _, n in held])), names

    for batch in batches:
        for text, name in zip(batch.column(1), batch.column(0), strict=True):
            data = np.frombuffer(text.as_buffer(), np.uint8)
            while len(data):
                part = data[:most]
                if len(data) > most:
                    ends = np.flatnonzero(KIND[part] == BREAK)
                    later = np.flatnonzero(KIND[data[most:]] == BREAK)[:1] + most
                    cut = ends[-1] if len(ends) else later[0] if len(later) else len(data) - 1
                    part = data[: cut + 1]
                data = data[len(part) :]
                held.append((part, name.as_py()))
                size += len(part)
                if size >= most:
                    yield made()
                    held, size = [], 0
    if held:
        yield made()


def _scanned(shard: DataFrame, sent: Broadcast, stretch: int, *how: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for found, names in _stretches(batches, stretch):
            yield from counted(found, names, *how, *sent.value)

    return shard.select("lang", "text").mapInArrow(run, COUNTS)


def _trimmed(shard: DataFrame, sent: Broadcast, stretch: int, settled: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for found, names in _stretches(batches, stretch):
            yield from frequent_runs(found, names, settled, sent.value[0])

    return shard.select("lang", "text").mapInArrow(run, "lang string, text string")


def frequent_phrases(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    longest: int = 5,
    least: int = 100,
    shards: int = 2,
    stretch_bytes: int = STRETCH_BYTES,
    filter_slots: int = FILTER_SLOTS,
) -> DataFrame:
    """Columns lang, phrase, len and c (occurrences) of all phrases of 1 to `longest` words with c >= `least`.

    A row with len 0 and an empty phrase holds the number of words of each language. Texts
    are dealt to `shards` shards, which are scanned in a cycle, all lengths side by side. Words are
    counted from the start. A longer phrase comes into question for one full cycle after
    both phrases one word shorter have reached `least` in the counts so far, however many shards those
    have seen. A phrase with `least` occurrences has at least `least` / `shards` of them in some shard of that
    cycle; there it is activated, and it is counted for one full cycle from the next step on. Scans end when no
    phrase is in question or active. So phrases too rare to matter, which are most, leave no state behind.

    Whether a shard holds enough of a phrase is counted by 64-bit hashes: where two phrases share one, both
    may be activated, and both are counted in full, by their texts. What tasks know of phrases that
    have reached `least` or are active are two filters of `filter_slots` numbers, whatever their number; a
    wrong yes adds to the work or is dropped by a join with the activated hashes, so counts are
    exact. Once all phrases of two words are counted, and again after those of three and so on, the shards are written
    anew with only the runs of words that longer phrases can still be made of. Each step writes its open and finished phrases and goes on from those files; the
    files of a step that is done with are removed.

    Texts are lower-cased (A-Z only) and split at [.,;:!?\\x0A-\\x0D]; words are `[^\\x20\\x09]+`.
    Null texts count as empty, null languages as 'und'; repeated rows count each; an
    empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    if not 1 <= shards * (2 * longest - 1) <= 32:
        raise ValueError("shards * (2 * longest - 1) must be at most 32")
    ship(spark)
    source = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), texts(docs, text_col).alias("text")
    ).where("text <> ''")
    dealt = source.withColumn("shard", F.pmod(F.xxhash64("lang", "text"), F.lit(shards)).cast("int"))
    base = written_path(spark)
    dealt.write.partitionBy("shard").option("compression", "zstd").parquet(f"{base}/shards")
    in_use, dealt_as = f"{base}/shards", "lang string, text string, shard int"
    whole = spark.read.schema(dealt_as).parquet(in_use)

    reached, active = np.zeros(filter_slots, np.uint32), np.zeros(filter_slots, np.uint32)
    started = spark.createDataFrame([], "h long, since int")
    finished: DataFrame | None = None
    open_path, step, last_step = None, 0, shards - 1
    while step <= last_step:
        sent = spark.sparkContext.broadcast((reached, active))
        # The phrases of a length are all counted two cycles after those one word shorter.
        cycles, begun = divmod(step, shards)
        settled = (cycles + 1) // 2
        if not begun and cycles % 2 and 2 <= settled <= longest - 2:
            before, in_use = in_use, f"{base}/runs{settled}"
            for n in range(shards):
                runs = _trimmed(whole.where(F.col("shard") == n), sent, stretch_bytes, settled)
                runs.write.option("compression", "zstd").parquet(f"{in_use}/shard={n}")
            whole = spark.read.schema(dealt_as).parquet(in_use)
            removed(spark, before)
        scan = _scanned(whole.where(F.col("shard") == step % shards), sent, stretch_bytes, longest, step, shards)
        enough = F.col("phrase").isNotNull() | (F.col("c") * shards >= least)
        counted_path = f"{base}/counts{step}"
        scan.groupBy("lang", "phrase", "len", "h").agg(F.sum("c").alias("c")).where(enough).write.parquet(counted_path)
        counts = spark.read.schema(COUNTS).parquet(counted_path)
        sent.destroy()

        fresh = counts.where("phrase is null").select("h").join(started, "h", "left_anti")
        new = written(fresh.withColumn("since", F.lit(step + 1)))
        if _mark(active, new, step):
            last_step = max(last_step, step + shards)

        now = counts.where("len <= 1").withColumn("since", F.lit(0))
        longer = counts.where("len > 1").join(started, "h").where((F.col("since") + shards > step) & (F.col("since") <= step))
        rows = now.unionByName(longer).withColumn("reach", F.lit(None).cast("int"))
        if open_path:
            rows = rows.unionByName(spark.read.schema(STATE).parquet(open_path))
        state = rows.groupBy("lang", "phrase", "len").agg(
            F.max("h").alias("h"), F.sum("c").alias("c"), F.max("since").alias("since"), F.max("reach").alias("reach")
        ).withColumn("reach", F.coalesce("reach", F.when(F.col("c") >= least, step)))
        done = F.col("since") + shards <= step + 1
        path = f"{base}/step{step}"
        kept = state.withColumn("done", done).where(~done | (F.col("c") >= least) | (F.col("len") == 0))
        kept.write.partitionBy("done").parquet(path)
        after = spark.read.schema(f"{STATE}, done boolean").parquet(path)
        ended = after.where("done").select("lang", "phrase", "len", "c")
        finished = ended if finished is None else finished.union(ended)
        if _mark(reached, after.where((F.col("reach") == step) & F.col("len").between(1, longest - 1)), step):
            last_step = max(last_step, step + shards)
        started = started.union(new)
        for old in filter(None, (open_path, counted_path)):
            removed(spark, old)
        left = f"{path}/done=false"
        open_path = left if present(spark, left) else None
        step += 1
    removed(spark, in_use)
    return finished


def _mark(table: np.ndarray, new: DataFrame, step: int) -> bool:
    """Sets this step's bit in the slots of the hashes of `new`; at most one row a slot comes here."""
    size = len(table)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(slots(hashes, size)))], ["slot"])

    at = new.select("h").mapInArrow(work, "slot long").distinct().toArrow().column("slot").to_numpy()
    table[at] |= np.uint32(1 << step)
    return len(at) > 0


def _first_words(phrase: Column) -> Column:
    """All words but the last."""
    return F.regexp_replace(phrase, " [^ ]*$", "")


def _last_words(phrase: Column) -> Column:
    return F.regexp_replace(phrase, "^[^ ]* ", "")


def collocations(
    found: DataFrame, longest: int = 5, closed_percent: int = 100, unit: int = 1000, top: int | None = 2000
) -> DataFrame:
    """Columns lang, rank, phrase, a, l, r, n and score of the phrases of two and more words.

    `found` is as frequent_phrases gives it. Cutting a phrase of count a after its first k words gives parts of
    counts l and r and floor(unit * a * n / (l * r)); the least of these counts, ties to the smallest k.
    A phrase goes if a longer one that holds it has at least `closed_percent` of its occurrences: as
    counts never grow with length, it is enough to look at those one word longer. `top` rows a
    language by score and count, descending, and the phrase's UTF-8 bytes (None: all).
    Products are decimals of 38 digits. An empty input gives an empty result.
    """
    rows = written(found)
    words = rows.where("len >= 1").select("lang", "phrase", "c")
    phrases = rows.where("len >= 2").withColumnRenamed("c", "a")
    parts = F.split("phrase", " ")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("len") - 1))).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice(parts, F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice(parts, F.col("k") + 1, F.col("len") - F.col("k")), " ").alias("rest"),
    )
    part = lambda name, c: words.select("lang", F.col("phrase").alias(name), F.col("c").alias(c))
    totals = rows.where("len = 0").groupBy("lang").agg(F.sum("c").alias("n"))
    scored = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    big = lambda c: f"cast({c} as decimal(38, 0))"
    score = F.expr(f"({big('a')} * {big('n')} * {big(unit)}) div ({big('l')} * {big('r')})")
    least = scored.groupBy("lang", "phrase", "a", "n").agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    )
    longer = phrases.select(
        "lang", "a", F.explode(F.array(_first_words(F.col("phrase")), _last_words(F.col("phrase")))).alias("phrase")
    ).groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    kept = least.join(longer, ["lang", "phrase"], "left").where(
        F.col("within").isNull() | (F.expr(f"{big('within')} * 100 < {big('a')} * {closed_percent}"))
    ).select("lang", "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").alias("score"))
    best = [F.desc("score"), F.desc("a"), "phrase"]
    if top is not None:
        # No language is one group: the first of each slice of it come before the first of all.
        slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        slice_of = F.pmod(F.xxhash64("phrase"), F.lit(slices))
        kept = kept.withColumn("slice", slice_of)
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*best)))
        kept = kept.where(F.col("rank") <= top).drop("slice", "rank")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
