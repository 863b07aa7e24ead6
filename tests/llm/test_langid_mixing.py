import pytest
from pyspark.sql import functions as F

from glossweave.llm import langid, mixing
from glossweave.llm.queries import ORACLES, QUERIES
from tests.llm import plain
from tests.oracle import connect, differences

FOLDER = "/root/testdata/sf0.01"


def test_language_on_held_out(spark):
    langs = {d.doc_id: d.lang for d in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op8_langid"](spark, FOLDER).collect()
    assert len(rows) == len(langs)
    assert all(r.held_out == plain.held_out(r.doc_id, 3, 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)


def test_language_edges(make_docs):
    docs = make_docs([
        (1, "the cat", "en", "a"), (2, "le chat", "fr", "a"), (3, None, "en", None), (4, "12 !", None, "a"),
        (5, "x" * 30_000, None, "a"), (None, "the", "en", "a"), (1, "the cat", "en", "a"),
    ]).withColumn("lang_pred", F.lit("no")).withColumn("given", F.lit(1))
    pieces = ["▁the", "▁le", "▁", "c", "a", "t", "h", "ch", "at"]
    found = langid.classify(docs, langid.fit(docs, pieces)).collect()
    assert len(found) == 7
    assert [r.lang_pred for r in found if r.doc_id in (1, 2, 3, 4)] == ["en", "fr", "und", "und", "en"]
    empty = langid.fit(docs.limit(0), pieces)
    assert {r.lang_pred for r in langid.classify(docs, empty).collect()} == {"und"}
    assert langid.classify(docs.limit(0), empty).count() == 0


def test_forward_sums_all_cuts():
    import numpy as np

    pieces = ["▁", "a", "b", "ab", "▁a"]
    logp = np.log(np.array([[0.1], [0.2], [0.3], [0.15], [0.05], [0.2]]))
    p = dict(zip(pieces, np.exp(logp[:, 0]), strict=False))
    want = p["▁"] * p["a"] * p["b"] + p["▁"] * p["ab"] + p["▁a"] * p["b"]
    lattice = langid.Lattice(pieces)
    assert np.exp(langid.word_scores(lattice, logp, ["ab"]))[0, 0] == pytest.approx(want)
    uses = langid.expected_uses(lattice, logp, ["ab"], np.array([0]), np.array([2.0]))
    assert uses[3, 0] == pytest.approx(2 * p["▁"] * p["ab"] / want)
    assert uses[2, 0] == pytest.approx(2 * (want - p["▁"] * p["ab"]) / want)


def test_mixing_against_sql(spark):
    assert differences(QUERIES["op9_mixing"](spark, FOLDER), connect(FOLDER), ORACLES["op9_mixing"]) == []


def _plain_targets(sizes, weights, epochs):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[n % len(weights)] for n, s in enumerate(names)}
    total, done = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in done]
        left = total - sum(done.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > epochs * sizes[s]]
        if not over:
            return done | share
        done |= {s: epochs * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 5, "d": 40, None: 7, "é": 90, "z": 0}, {"a": 1}, {None: 5, "b": 5}, {"a": 0, "b": 0},
    {f"s{n:02d}": (n * 37) % 101 for n in range(40)},
])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df, (5, 2, 1), 3).collect()}
    want = _plain_targets(sizes, (5, 2, 1), 3)
    assert got == pytest.approx(want)


def test_mix_edges(make_docs):
    docs = make_docs(
        [(n, "w " * (n % 9), "en", "a" if n % 3 else None) for n in range(200)]
        + [(None, None, None, "b"), (5, "x y", "en", "a"), (5, "x y", "en", "a")]
    ).withColumn("block", F.lit(1)).withColumn("size", F.lit(9))
    made = mixing.mix(docs, mixing.word_count(F.col("text"))).collect()
    assert len(made) == 203
    for name, rows in plain.groups((r.source, r) for r in made).items():
        taken = sum(r["size"] * r.repeats for r in rows)
        assert abs(taken - rows[0].target) <= 9, name
        assert all(0 <= r.repeats <= 3 for r in rows)
        assert rows[0].source_size == sum(r["size"] for r in rows)
    assert mixing.mix(docs.limit(0), F.lit(1)).count() == 0
