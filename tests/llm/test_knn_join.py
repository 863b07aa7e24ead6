import math

import numpy as np
import pytest

from glossweave.llm import knn_join
from glossweave.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>"


def _whole(v, scale):
    return [int(x) * scale if abs(x) >= 2.0**52 else math.floor(x * scale) for x in v]


def _want(data, asked, k, scale=1024):
    """All pairs in Python integers; an id with several vectors counts with its best score."""
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    rows = [(i, _whole(v, scale)) for i, v in data if i is not None and ok(v)]
    out = {}
    for q, v in asked:
        if q is None or not ok(v):
            continue
        mine = out.setdefault(q, {})
        for i, w in rows:
            if i != q:
                score = sum(a * b for a, b in zip(_whole(v, scale), w, strict=False))
                score = min(max(score, -(1 << 63)), (1 << 63) - 1)
                mine[i] = max(mine.get(i, score), score)
    return {
        (q, n + 1, i, s) for q, mine in out.items()
        for n, (s, i) in enumerate(sorted(((s, i) for i, s in mine.items()), key=lambda x: (-x[0], x[1]))[:k])
    }


def _check(spark, data, asked, k=3, **more):
    a, b = spark.createDataFrame(data, SCHEMA), spark.createDataFrame(asked, SCHEMA)
    rows = knn_join.top_products(a, b, k=k, **more).collect()
    got = {(r.query_id, r.rank, r.id, r.score) for r in rows}
    assert got == _want(data, asked, k) and len(rows) == len(got)


ODD = [
    (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0, None]), (7, [float("nan"), 1.0]),
    (8, [float("inf"), 1.0]), (9, [1.0]), (10, [1.0, 0.1]), (None, [9.0, 9.0]), (11, [-0.0001, -3.0]), (12, []), (2, [1.0, 0.0]),
    (3, [-5.0, 5.0]), (100, [0.5, 0.25]), (200, [0.0, 0.0]), (300, [1.0, 0.0, 7.0]),
]


def test_odd_rows(spark):
    _check(spark, ODD, ODD)
    _check(spark, ODD, ODD, k=30)
    _check(spark, ODD[:1], ODD[:1])


@pytest.mark.parametrize("size", [1e-9, 1e5, 1e9, 1e15, 1e200, 1e308])
def test_any_magnitude(spark, size):
    pick = np.random.default_rng(5)
    data = [(n, (pick.normal(size=3).clip(-1.7, 1.7) * size).tolist()) for n in range(40)]
    _check(spark, data, data[::5], cell_rows=8, group_rows=4)


def test_clusters_are_told_apart(spark, monkeypatch):
    """Where pivots separate the data, rows go only to the groups that they can be near to; results are the same."""
    pick = np.random.default_rng(8)
    centres = pick.normal(size=(12, 6)) * 5
    data = [(n, (centres[n % 12] + pick.normal(size=6) * 0.05).tolist()) for n in range(900)]
    data += [(1000 + n, data[0][1]) for n in range(300)] + [(n, data[n + 1][1]) for n in range(3)]
    asked = data[::20]
    copies, plain_met = [], knn_join.met

    def counted(points, *more):
        copies.append(points.count())
        return plain_met(points, *more)

    monkeypatch.setattr(knn_join, "met", counted)
    _check(spark, data, asked, k=4, cell_rows=60, group_rows=5)
    # Two rounds; each would be a copy of every row for every group of queries without bounds.
    groups = max(1, len(asked) // 5)
    assert len(copies) == 2 and copies[1] < 0.5 * groups * 900


def test_empty_tables_and_extra_columns(spark, folder_of):
    odd = spark.createDataFrame([r for r in ODD if r[0] != 3], SCHEMA)
    more = odd.selectExpr("*", "1 as id", "2 as score", "3 as cell", "4 as best")
    rows = QUERIES["op12_knn_join"](spark, folder_of(embeddings=more)).collect()
    data = [r for r in ODD if r[0] != 3]
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in rows} == _want(data, [r for r in data if (r[0] or 1) % 100 == 0], 10)
    assert QUERIES["op12_knn_join"](spark, folder_of(embeddings=odd.limit(0))).count() == 0
    assert QUERIES["op12_knn_join"](spark, folder_of(embeddings=odd.where("vec_id < 50"))).count() == 0
