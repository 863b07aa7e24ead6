import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossweave.llm import quality_crf
from glossweave.llm.queries import QUERIES
from tests.llm import plain

FOLDER = "/root/testdata/sf0.01"


def test_held_out_documents(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = QUERIES["op10_quality"](spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for r in rows:
        assert r.held_out == plain.held_out(r.doc_id, 5, 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(r, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == q for r, q in held) >= 0.93 * len(held)


def test_marginals_against_all_labelings():
    pick = np.random.default_rng(2)
    model = quality_crf.Model(pick.normal(size=quality_crf.WIDTH), pick.normal(size=(2, 2)))
    docs = [pick.normal(size=(n, quality_crf.WIDTH)) for n in (1, 4, 3, 5)]
    good, pairs, total = quality_crf.marginals(model, docs)
    want_pairs = np.zeros((2, 2))
    for doc, found in zip(docs, good, strict=True):
        weight, share = 0.0, np.zeros(len(doc))
        own = np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=len(doc)):
            p = np.exp(sum((doc @ model.weights)[t] * y[t] for t in range(len(doc))) + sum(model.moves[a, b] for a, b in itertools.pairwise(y)))
            weight += p
            share += p * np.array(y)
            for a, b in itertools.pairwise(y):
                own[a, b] += p
        assert found == pytest.approx(share / weight)
        want_pairs += own / weight
    assert pairs == pytest.approx(want_pairs)


def test_edges(make_docs, spark):
    docs = make_docs([None, "", "\n\n", "word " * 40_000, "line\n" * 5_000, "a", "a"]).withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, None), (None, 1), (5, 7)], "doc_id long, quality int")
    model = quality_crf.fit(docs, labels, fit_lines=6_000)
    rows = quality_crf.score(docs, model, lines_name="lines").collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id: len(r.lines) for r in rows} == {0: 1, 1: 1, 2: 3, 3: 1, 4: 5001, 5: 1, 6: 1}
    none = quality_crf.fit(docs, labels.limit(0))
    assert {r.score for r in quality_crf.score(docs, none).collect()} == {0.5}
    assert quality_crf.score(docs.limit(0), none).count() == 0
