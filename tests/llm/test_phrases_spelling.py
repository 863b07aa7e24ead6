import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from glossweave.llm import phrases, spelling
from glossweave.llm.queries import ORACLES, QUERIES
from tests.llm import plain
from tests.oracle import connect, differences

FOLDER = "/root/testdata/sf0.001"


def _frequent(rows, longest, least):
    """(lang, phrase) -> count; with ('', lang) -> number of words."""
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang or "und", " ".join(words[i : i + k])) for i in range(len(words) - k + 1))
    return {k: n for k, n in counts.items() if n >= least}, totals


TEXTS = [
    "a b a b a b, a b c. A B\tc d e", "", None, "x" * 5000 + " a b", "a b a b a b, a b c. A B\tc d e",
    "Ä b Ä b ä B", "a a a a a a a a", "...;;\n\n  \t", "a b a b", "b,a;b:a!b?a\x0bb\x0ca\rb",
]


@pytest.mark.parametrize("stretch, slots, shards", [(8 << 20, 1 << 22, 2), (16, 1 << 22, 1), (64, 4, 3)])
def test_frequent_phrases(spark, make_docs, stretch, slots, shards):
    """All counts, whatever the stretches, the shards and the size of the filter."""
    rows = [(t, lang) for n, t in enumerate(TEXTS) for lang in ("en", None, "de")[: 1 + n % 3]]
    docs = make_docs([(n, t, lang, "s") for n, (t, lang) in enumerate(rows)])
    found = phrases.frequent_phrases(docs, least=3, shards=shards, stretch_bytes=stretch, filter_slots=slots).collect()
    want, totals = _frequent(rows, 5, 3)
    assert {(r.lang, r.phrase): r.c for r in found if r.len} == want
    assert {r.lang: r.c for r in found if not r.len} == {k: n for k, n in totals.items() if n}
    assert all(r.len == len(r.phrase.split(" ")) for r in found if r.len)


def test_stretches_cut_long_texts():
    """A text longer than a stretch is cut where a piece ends, or not at all."""
    texts = ["one two. three four five six, seven", "no break at all in this", "x.y.z"]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 3), pa.array(texts)], ["lang", "text"])
    words = [w for found, _ in phrases._stretches(iter([batch]), 8) for w in found.words.take(pa.array(found.code)).to_pylist()]
    assert words == [w for t in texts for w in re.findall(r"[^ .,]+", t)]


def test_later_steps_read_runs_only(spark, make_docs, monkeypatch):
    """Steps for longer phrases read only what these can still be made of; counts stay whole."""
    words = [f"w{n}" for n in range(400)]
    rows = [(" ".join([*words[k::7], "a b c d e", "a b x b c, a", "q r", *words[k::5]]), "en") for k in range(5)] * 2
    read, scanned = {}, phrases._scanned

    def seen(shard, sent, stretch, longest, step, shards):
        read[step] = shard.selectExpr("coalesce(sum(octet_length(text)), 0)").head()[0]
        return scanned(shard, sent, stretch, longest, step, shards)

    monkeypatch.setattr(phrases, "_scanned", seen)
    docs = make_docs([(n, t, lang, "s") for n, (t, lang) in enumerate(rows)])
    found = phrases.frequent_phrases(docs, least=10, shards=1).collect()
    assert {(r.lang, r.phrase): r.c for r in found if r.len} == _frequent(rows, 5, 10)[0]
    assert max(len(r.phrase.split()) for r in found) == 5
    assert [read[step] for step in (0, 2)] == [sum(len(t) for t, _ in rows)] * 2
    assert read[3] == read[4] == 10 * len("a b c d e a b x b c\na q r\n")
    assert read[5] == read[8] == 10 * len("a b c d e a b x b c\n")


@pytest.mark.parametrize("most, joined", [(1024, [("de", "a b c d\n"), ("en", "a b c\nb c d\n")]), (1, None)])
def test_frequent_runs(most, joined):
    """Runs keep their order and pieces; a text ends only where a run does."""
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de", "en"]), pa.array(["x A b c, b c d", "a b c d x a b", "b c"])], ["lang", "text"])
    (found, names), = phrases._stretches(iter([batch]))
    table = np.zeros(1 << 16, np.uint32)
    word = dict(zip(found.words.to_pylist(), phrases.word_hashes(found.words), strict=True))
    for name, own in zip(names, phrases._hashes(names), strict=True):
        for phrase in ["a", "b", "c", "d", "a b", "b c", "c d"]:
            h = np.array([own])
            for w in phrase.split():
                h = phrases.longer_by(h, np.array([word[w]]))
            table[phrases.slots(h, len(table))] = 1
    rows = [r for b in phrases.frequent_runs(found, names, 2, table, most) for r in b.to_pylist()]
    if joined:
        assert [(r["lang"], r["text"]) for r in rows] == joined
    assert "".join(r["text"] for r in rows) == "a b c d\na b c\nb c d\n"
    assert all(r["text"].endswith("\n") for r in rows)
    assert list(phrases.frequent_runs(found, names, 2, np.zeros(8, np.uint32))) == []


def test_word_hashes():
    """Equal words have equal hashes, wherever they stand in an array, and others don't."""
    words = ["a", "b", "ab", "ba", "x" * 5000, "x" * 5001, "é", "\x00", "\x00\x00"]
    hashes = phrases.word_hashes(pa.array(words))
    assert len(set(hashes.tolist())) == len(words)
    assert (phrases.word_hashes(pa.array(["zz", *words[3:]])[1:]) == hashes[3:]).all()
    assert len(phrases.word_hashes(pa.array([], pa.string()))) == 0


@pytest.mark.parametrize("name", ["op11_phrases", "op12_knn_join"])
def test_against_sql(spark, name):
    wrong = differences(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name])
    assert [w for w in wrong if "type of rank" not in w] == []


def test_collocations_of_nothing(spark, make_docs, folder_of):
    for rows in ([], [None, ""]):
        docs = make_docs(rows) if rows else make_docs([""]).limit(0)
        assert QUERIES["op11_phrases"](spark, folder_of(documents=docs)).count() == 0


def test_collocations_of_large_counts(spark):
    """Products beyond 64 bits are exact, and the first of equal cuts counts."""
    n, a = 3 * 10**15 + 7, 2 * 10**14 + 3
    rows = [("en", "", 0, n), ("en", "p", 1, 5 * 10**14 + 1), ("en", "q", 1, 4 * 10**14 + 9), ("en", "p q", 2, a),
            ("en", "q q", 2, a), ("en", "p q q", 3, a - 1)]
    found = spark.createDataFrame(rows, "lang string, phrase string, len int, c long")
    got = {r.phrase: (r.rank, r.l, r.r, r.score) for r in phrases.collocations(found, closed_percent=200).collect()}
    p, q = rows[1][3], rows[2][3]
    score = {"p q": 1000 * a * n // (p * q), "q q": 1000 * a * n // (q * q)}
    cuts = [(1000 * (a - 1) * n // (p * a), 1, p, a), (1000 * (a - 1) * n // (a * q), 2, a, q)]
    assert (got["p q"][3], got["q q"][3]) == (score["p q"], score["q q"])
    assert got["p q q"][1:] == (min(cuts)[2], min(cuts)[3], min(cuts)[0])
    assert sorted(v[0] for v in got.values()) == [1, 2, 3]


def test_longer_phrase_hides_shorter(spark, make_docs):
    # All of these score 1000 * 19 // 7; the larger count comes first.
    docs = make_docs(["u v w"] * 5 + ["u v"] * 2)
    rows = phrases.frequent_phrases(docs, least=3)
    assert {r.phrase for r in phrases.collocations(rows).collect()} == {"u v", "u v w"}
    assert {r.phrase for r in phrases.collocations(rows, closed_percent=50).collect()} == {"u v w"}
    assert [r.phrase for r in phrases.collocations(rows, top=1).collect()] == ["u v"]


def test_repeats_and_clashing_columns(spark, make_docs):
    docs = make_docs(["m n"] * 4).union(make_docs(["m n"])).selectExpr("*", "1 as phrase", "2 as len", "3 as shard", "4 as c")
    got = {(r.phrase, r.c) for r in phrases.frequent_phrases(docs, least=5).collect()}
    assert got == {("", 10), ("m", 5), ("n", 5), ("m n", 5)}


def _got(rows):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_spelling_against_all_words(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    rows = QUERIES["op13_spelling"](spark, FOLDER).collect()
    want = plain.variants(plain.spelled(docs))
    assert _got(rows) == want and len(rows) == len(want)


@pytest.mark.parametrize("task_rows", [1, 3, 40, 10_000])
def test_variants_in_tasks_of_any_size(spark, task_rows):
    """Buckets, and slices of halves that many words share, give the same links once each."""
    pick = np.random.default_rng(3)
    words = {"".join(pick.choice(list("abé"), pick.integers(1, 9))): int(10 ** pick.integers(0, 5)) for _ in range(250)}
    words |= {"aaaaaaaa": 1, "aaaaaaa": 10, "aaaaaa": 100, "aaaaa": 1000, "z": 5, "\U0001f600a": 2, "\U0001f600b": 20}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    rows = spelling.variants(df, task_rows=task_rows).collect()
    assert _got(rows) == plain.variants(words) and len(rows) == len(words)


def test_long_words_and_chains(spark, make_docs):
    long = "x" * 3000
    texts = [f"{long} {long}y {long[:-1]}z"] * 3 + ["chaining " * 500 + "chainin " * 40 + "chaini " * 2 + "chaimin chaimin"]
    rows = [(None if n == 2 else n, t, "en", "a") for n, t in enumerate(texts)]
    docs = make_docs(rows).selectExpr("*", "1 as word", "2 as n")
    want = plain.variants(plain.spelled([(r[0], r[1]) for r in rows]))
    assert _got(spelling.spelling_variants(docs).collect()) == want
    assert want["chainin"][:2] == ("chaining", "chaining")


def test_no_words(spark, make_docs, folder_of):
    for docs in (make_docs([None, "", "short words 12345678 only", "oncewritten"]), make_docs([""]).limit(0)):
        assert QUERIES["op13_spelling"](spark, folder_of(documents=docs)).count() == 0
