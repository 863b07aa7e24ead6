"""Language identification by unigram pieces, summed over all segmentations of a word."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.llm.common import cut, drop_kept, fresh, kept, over_batches, ship

WORD = regex.compile(r"\p{L}+")
UNKNOWN = "und"
#: Words scored side by side, and words a worker remembers.
CHUNK = 4096
REMEMBERED = 1 << 17
#: What a piece never seen in a language counts as, in expected uses.
FLOOR = 0.05


def read_pieces(path: str) -> list[str]:
    """The lower-cased pieces of a sentencepiece vocabulary, word starts as `▁`, in its order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()))
    return list(dict.fromkeys(p for p in pieces if regex.fullmatch(r"▁?\p{L}*", p) and p))


class Lattice:
    """All ways to cut words into pieces of a fixed vocabulary.

    A character that is no piece can stand alone as the unknown piece, number V. Pieces are
    found by 64-bit rolling hashes of all substrings of many words at a time.
    """

    BASE, MIX, SLOTS = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15), 18

    def __init__(self, pieces: list[str]):
        self.unknown = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        self.sizes = np.array([*map(len, pieces), 1])
        marks = np.zeros(len(pieces), np.uint64)
        with np.errstate(over="ignore"):
            for n, piece in enumerate(pieces):
                for c in piece:
                    marks[n] = marks[n] * self.BASE + np.uint64(ord(c))
        # Pieces whose slot is taken go to a further table.
        self.tables, left = [], np.arange(len(pieces))
        while len(left):
            slot = self._slot(marks[left], len(self.tables))
            _, first = np.unique(slot, return_index=True)
            number, mark = np.full(1 << self.SLOTS, -1, np.int32), np.zeros(1 << self.SLOTS, np.uint64)
            number[slot[first]], mark[slot[first]] = left[first], marks[left[first]]
            self.tables.append((number, mark))
            left = np.delete(left, first)

    def _slot(self, marks: np.ndarray, level: int) -> np.ndarray:
        return ((marks ^ (marks >> np.uint64(29 + level))) * self.MIX) >> np.uint64(64 - self.SLOTS)

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the marked words and [word, end, size - 1] -> piece number, or -1."""
        marked = ["▁" + w for w in words]
        sizes = np.array([len(w) for w in marked])
        wide, reach = int(sizes.max()), min(self.longest, int(sizes.max()))
        codes = np.zeros((len(marked), wide), np.uint64)
        inside = np.arange(wide) < sizes[:, None]
        codes[inside] = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
        table = np.full((len(marked), wide + 1, reach), -1, np.int32)
        rolled = np.zeros((len(marked), wide + 1), np.uint64)
        for size in range(1, reach + 1):
            rolled = rolled[:, :-1] * self.BASE + codes[:, size - 1 :]
            found = table[:, size:, size - 1]
            for level, (number, mark) in enumerate(self.tables):
                slot = self._slot(rolled, level)
                found[:] = np.where(mark[slot] == rolled, number[slot], found)
            found[~inside[:, size - 1 :]] = -1
        alone = table[:, 1:, 0]
        alone[(alone < 0) & inside] = self.unknown
        return sizes, table


def _log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis)
    safe = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(values - np.expand_dims(safe, axis)).sum(axis=axis))


def forward(table: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Log of the summed probability of all cuts of each prefix: [word, end, language]."""
    words, ends, reach = table.shape
    full = np.vstack([logp, np.full((1, logp.shape[1]), -np.inf)])
    alpha = np.full((words, ends, logp.shape[1]), -np.inf)
    alpha[:, 0] = 0
    for end in range(1, ends):
        k = min(reach, end)
        before = alpha[:, end - k : end][:, ::-1]
        alpha[:, end] = _log_sum(before + full[table[:, end, :k]], axis=1)
    return alpha


def _chunks(words: list[str]):
    """Words in stretches of similar length, so that long words don't widen the tables."""
    order = sorted(range(len(words)), key=lambda n: len(words[n]))
    begin = 0
    while begin < len(order):
        width = len(words[order[min(begin + CHUNK, len(order)) - 1]]) + 1
        count = max(1, min(CHUNK, (CHUNK * 32) // width))
        yield order[begin : begin + count]
        begin += count


def word_scores(lattice: Lattice, logp: np.ndarray, words: list[str]) -> np.ndarray:
    """Log probability of each word in each language.

    Sums are of plain probabilities, raised by a factor per character so that they keep their
    size; where a long word still leaves the range of doubles, logarithms are summed.
    """
    out = np.empty((len(words), logp.shape[1]))
    per_char = np.log(16.0)
    raised = np.vstack([np.exp(logp + per_char * lattice.sizes[:, None]), np.zeros((1, logp.shape[1]))])
    for part in _chunks(words):
        sizes, table = lattice.edges([words[n] for n in part])
        rows, ends, reach = table.shape
        alpha = np.zeros((rows, ends, logp.shape[1]))
        alpha[:, 0] = 1
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            for end in range(1, ends):
                k = min(reach, end)
                alpha[:, end] = np.einsum(
                    "nkl,nkl->nl", alpha[:, end - k : end][:, ::-1], raised[table[:, end, :k]]
                )
            found = np.log(alpha[np.arange(rows), sizes]) - per_char * sizes[:, None]
        lost = np.flatnonzero(~np.isfinite(found).all(axis=1))
        if len(lost):
            found[lost] = forward(table[lost], logp)[np.arange(len(lost)), sizes[lost]]
        out[part] = found
    return out


def expected_uses(
    lattice: Lattice, logp: np.ndarray, words: list[str], langs: np.ndarray, counts: np.ndarray
) -> np.ndarray:
    """Expected uses of each piece in each language, over all cuts of counted words."""
    uses = np.zeros_like(logp)
    for part in _chunks(words):
        sizes, table = lattice.edges([words[n] for n in part])
        lang, n = langs[part], np.arange(len(part))
        alpha = forward(table, logp)[n, :, lang]
        reach = table.shape[2]
        own = np.where(table >= 0, logp[table, lang[:, None, None]], -np.inf)
        beta = np.full(alpha.shape, -np.inf)
        beta[n, sizes] = 0
        for end in range(table.shape[1] - 1, 0, -1):
            for size in range(1, min(reach, end) + 1):
                at = end - size
                beta[:, at] = np.logaddexp(beta[:, at], own[:, end, size - 1] + beta[:, end])
        total = alpha[n, sizes]
        for size in range(1, reach + 1):
            weight = np.exp(alpha[:, :-size] + own[:, size:, size - 1] + beta[:, size:] - total[:, None])
            word, place = np.nonzero(table[:, size:, size - 1] >= 0)
            np.add.at(
                uses, (table[word, place + size, size - 1], lang[word]),
                weight[word, place] * counts[part][word],
            )
    return uses


class Model:
    """Piece log-probabilities [piece, language], the languages and their log priors."""

    def __init__(self, pieces: list[str], langs: list[str], logp: np.ndarray, prior: np.ndarray):
        self.pieces, self.langs, self.logp, self.prior = pieces, langs, logp, prior


def fit(
    labelled: DataFrame,
    pieces: list[str],
    text_col: str = "text",
    lang_col: str = "lang",
    key_col: str = "doc_id",
    fit_docs: int = 4_000,
    rounds: int = 2,
) -> Model:
    """Learn piece probabilities from rows with a language.

    `fit_docs` bounds the sample: about that many rows, picked by a hash of `key_col`, with
    their whole texts (all rows, if fewer). Words are counted per language on the cluster;
    each round of expectation-maximisation hands out expected uses from there and brings back one
    number per piece and language. Rows with a null language or text don't count; without
    any row the model knows no language.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    many = rows.count()
    share = min(1.0, fit_docs / max(many, 1))
    picked = F.pmod(F.xxhash64(F.col(key_col), F.lit(8)), F.lit(1 << 20)) < int(share * (1 << 20))
    sample = (rows.where(picked) if share < 1 else rows).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")
    )
    words = F.explode(F.expr(r"regexp_extract_all(lower(text), '\\p{L}+', 0)"))
    counts = cut(sample.select("lang", words.alias("word")).groupBy("lang", "word").count())
    totals = {r[0]: r[1] for r in counts.groupBy("lang").sum("count").orderBy("lang").collect()}
    langs = list(totals)
    logp = np.full((len(pieces) + 1, max(1, len(langs))), -np.log(len(pieces) + 1))
    place = {x: n for n, x in enumerate(langs)}
    for _ in range(rounds if langs else 0):
        logp = _improved(counts, pieces, place, logp)
    prior = np.log(np.array([totals[x] for x in langs], float) / max(1, sum(totals.values())))
    return Model(pieces, langs, logp, prior)


def _improved(counts: DataFrame, pieces: list[str], place: dict[str, int], logp: np.ndarray) -> np.ndarray:
    ship(counts.sparkSession)
    sent = counts.sparkSession.sparkContext.broadcast((pieces, place, logp))
    schema = pa.schema([("piece", pa.int32()), ("lang", pa.int32()), ("uses", pa.float64())])

    def run(batches):
        drop_kept()
        pieces, place, logp = sent.value
        lattice, uses = Lattice(pieces), np.zeros_like(logp)
        for batch in batches:
            lang, word, count = (batch.column(k).to_pylist() for k in range(3))
            codes = np.array([place[x] for x in lang], np.int64)
            uses += expected_uses(lattice, logp, word, codes, np.array(count, float))
        piece, at = np.nonzero(uses)
        yield pa.RecordBatch.from_arrays(
            [pa.array(piece, pa.int32()), pa.array(at, pa.int32()), pa.array(uses[piece, at])], schema=schema
        )

    rows = counts.select("lang", "word", "count").mapInArrow(run, "piece int, lang int, uses double")
    uses = np.full_like(logp, FLOOR)
    for piece, at, n in rows.groupBy("piece", "lang").agg(F.sum("uses")).collect():
        uses[piece, at] += n
    return np.log(uses / uses.sum(axis=0))


class Memory:
    """Scores of the words that a worker has seen; emptied when full."""

    def __init__(self, model: tuple):
        self.langs, self.logp, self.prior = model[1:]
        self.lattice = Lattice(model[0])
        self.forget(1)

    def forget(self, room: int) -> None:
        self.place: dict[str, int] = {}
        self.values = np.empty((max(room, 1 << 12), self.logp.shape[1]))

    def totals(self, words: list[list[str]]) -> np.ndarray:
        """Per list of words (none empty) the sum of their scores."""
        flat = [w for ws in words for w in ws]
        place = self.place
        new = list({w for w in flat if w not in place})
        if len(place) + len(new) > REMEMBERED:
            self.forget(len(set(flat)))
            place, new = self.place, list(set(flat))
        if new:
            begin, end = len(place), len(place) + len(new)
            if end > len(self.values):
                self.values = np.vstack([self.values, np.empty((end, self.values.shape[1]))])
            self.values[begin:end] = word_scores(self.lattice, self.logp, new)
            place.update(zip(new, range(begin, end), strict=True))
        rows = self.values[np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))]
        begins = np.cumsum([0, *map(len, words[:-1])])
        return np.add.reduceat(rows, begins, axis=0)


def classify(
    docs: DataFrame, model: Model, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score"
) -> DataFrame:
    """`docs` with the likeliest language and its posterior probability.

    A text's probability is the product over its words (runs of letters, lower-cased) of the
    sum over all cuts into pieces. Texts that are null or have no letter, and every text when
    the model knows no language, get `und` and 0. Ties go to the language that sorts first.
    Whole texts are read; rows need no shuffle; columns of these names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.pieces, model.langs, model.logp, model.prior))
    mark = (len(model.pieces), tuple(model.langs), zlib.crc32(model.logp.tobytes()))
    names = [c for c in docs.columns if c not in (lang_name, score_name)]
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    # Whole texts are large: one that is kept anyway is sent once.
    sent_once = text_col in names and types[text_col] == "string"
    given = text_col if sent_once else fresh(docs, "given")[0]
    read = [] if sent_once else [F.col(f"`{text_col}`").cast("string").alias(given)]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], *read)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in names), f"`{lang_name}` string", f"`{score_name}` double"])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        memory = kept("languages", mark, lambda: Memory(sent.value))
        found, score = [], []
        for texts in _stretches(batch.column(batch.schema.get_field_index(given))):
            words = [WORD.findall(t.lower()) for t in texts]
            known = [n for n, ws in enumerate(words) if ws and memory.langs]
            labels, chance = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if known:
                total = memory.prior + memory.totals([words[n] for n in known])
                best = total.argmax(axis=1)
                sure = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                for n, b, p in zip(known, best.tolist(), sure.tolist(), strict=True):
                    labels[n], chance[n] = memory.langs[b], p
            found += labels
            score += chance
        columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
        made = [pa.array(found, pa.string()), pa.array(score, pa.float64())]
        return pa.RecordBatch.from_arrays([*columns, *made], [*names, lang_name, score_name])

    return over_batches(rows, work, schema, ("languages",))


def _stretches(column: pa.Array, most: int = 1 << 20):
    """The texts of a column in lists of about `most` characters."""
    part, size = [], 0
    for value in column:
        text = value.as_py() or ""
        part.append(text)
        size += len(text)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part
