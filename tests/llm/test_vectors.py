import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossweave.llm import ann, blockwise
from glossweave.llm.queries import QUERIES
from tests.llm import plain

FOLDER = "/root/testdata/sf0.01"
ODD = [
    (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [0.0, 0.0], 1), (5, None, 1),
    (6, [1.0, None], 1), (7, [float("nan"), 1.0], 1), (8, [float("inf"), 1.0], 1), (9, [1.0], 1),
    (10, [1.0, 0.1], 1), (11, [1.0, 0.1], None), (12, [1.0, 0.3], 1), (13, [1.0, 0.0], 2), (None, [1.0, 0.0], 1),
    (20, [0.5, 0.5], 1), (40, [-1.0, 0.2], 3), (2, [1.0, 0.0], 1),
]


def _good(v, size):
    return v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v) and any(v)


def _vectors(rows):
    size = 64 if len(rows[0][1]) == 64 else 2
    return {r[0]: np.array(r[1], np.float32).astype(float) for r in rows if r[0] is not None and _good(r[1], size)}


def _odd(spark):
    return spark.createDataFrame(ODD, "vec_id long, embedding array<float>, label int")


def _check_search(rows, vectors, least):
    found, asked = plain.groups((r.query_id, r) for r in rows), [i for i in vectors if i % 20 == 0]
    assert set(found) == set(asked)
    hits = total = 0
    for i in asked:
        mine = sorted(found[i], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(mine) + 1)) and i not in [r.vec_id for r in mine]
        for r in mine:
            assert r.score == pytest.approx(float(vectors[i] @ vectors[r.vec_id]), abs=1e-12)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        best = sorted((-float(vectors[i] @ v), j) for j, v in vectors.items() if j != i)[:20]
        assert len(mine) == len(best)
        hits += len({j for _, j in best} & {r.vec_id for r in mine})
        total += len(best)
    assert hits >= least * total


@pytest.mark.parametrize("rows", [64, 100_000])
def test_search_against_all_pairs(spark, monkeypatch, rows):
    monkeypatch.setattr(blockwise, "BLOCK_ROWS", rows)
    monkeypatch.setattr(blockwise, "CHUNK_ROWS", rows)
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    _check_search(QUERIES["op1_ann"](spark, FOLDER).collect(), _vectors([tuple(r) for r in table]), 0.95)


def test_search_with_a_deep_tree(spark):
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    found = ann.nearest(df, df.where("vec_id % 20 = 0"), cell_rows=40).withColumnRenamed("id", "vec_id")
    _check_search(found.collect(), _vectors([tuple(r) for r in df.collect()]), 0.95)


@pytest.mark.parametrize("size", [1e7, 1e-6])
def test_search_at_any_norm(spark, size):
    """Every query gets all its rows, and their scores, whatever the norm of the vectors."""
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet").selectExpr("vec_id", f"transform(embedding, x -> cast(x as double) * {size}) as embedding")
    vectors = {r.vec_id: np.array(r.embedding) / size for r in df.collect()}
    found = ann.nearest(df, df.where("vec_id % 20 = 0")).withColumn("score", F.col("score") / (size * size))
    _check_search(found.withColumnRenamed("id", "vec_id").collect(), vectors, 0.95)


def test_search_edges(spark, folder_of):
    odd = spark.createDataFrame(ODD[:-1], "vec_id long, embedding array<float>, label int")
    _check_search(QUERIES["op1_ann"](spark, folder_of(embeddings=odd)).collect(), _vectors(ODD), 1)
    assert ann.nearest(_odd(spark), _odd(spark)).count() > 0
    assert QUERIES["op1_ann"](spark, folder_of(embeddings=odd.limit(0))).count() == 0


def test_chi_square():
    assert ann.chi_square(ann.chi_square_point(0.9, 2), 2) == pytest.approx(0.9)
    assert ann.chi_square_point(0.95, 8) == pytest.approx(15.507, abs=1e-3)


def _check_links(rows, table):
    size = len(table[0][1])
    good = {r[0]: (np.array(r[1], np.float32).astype(float), r[2]) for r in table if r[0] is not None and r[2] is not None and _good(r[1], size)}

    def linked(a, b):
        (x, g), (y, h) = good[a], good[b]
        return g == h and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= 0.98

    want = plain.components(good, linked)
    for r in rows:
        if r.vec_id in good:
            assert r.n_links == sum(linked(r.vec_id, b) for b in good if b != r.vec_id), r
            assert r.component_id == want[r.vec_id]
        else:
            assert (r.n_links, r.component_id) == (0, r.vec_id)
        assert r.kept == (r.vec_id == r.component_id)


@pytest.mark.parametrize("rows", [16, 2048])
def test_links_against_all_pairs(spark, monkeypatch, rows):
    monkeypatch.setattr(blockwise, "BLOCK_ROWS", rows)
    monkeypatch.setattr(blockwise, "CHUNK_ROWS", rows)
    table = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    found = QUERIES["op6_pq"](spark, FOLDER).collect()
    assert len(found) == len(table)
    _check_links(found, table)


def test_links_edges(spark, folder_of):
    rows = [r for r in ODD[:-1]]
    odd = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = QUERIES["op6_pq"](spark, folder_of(embeddings=odd)).collect()
    assert len(found) == len(rows)
    _check_links([r for r in found if r.vec_id is not None], rows)
    assert QUERIES["op6_pq"](spark, folder_of(embeddings=odd.limit(0))).count() == 0
    assert QUERIES["op6_pq"](spark, folder_of(embeddings=_odd(spark))).count() == len(ODD)
    none = QUERIES["op6_pq"](spark, folder_of(embeddings=odd.where("embedding is null"))).collect()
    assert [(r.n_links, r.kept) for r in none] == [(0, True)]
