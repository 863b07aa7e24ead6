"""Exact top-k inner products by a Voronoi join: pivots, distance bounds, replication where needed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossweave.llm.blockwise import fitted_rows, matrix, met
from glossweave.llm.common import cut, over_batches
from glossweave.llm.pq import k_means

#: Queries whose scores are worked out side by side.
SIDE = 256
LEAST_LONG, LARGEST_LONG = -(1 << 63), (1 << 63) - 1
FOUND = "query_id long, id long, score long"


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles; from 2^52 on every double is a whole number already."""
    return np.floor(x * scale)


def scores(q: np.ndarray, x: np.ndarray, scale: int, largest: float) -> np.ndarray:
    """Inner products of whole components as int64, exact whatever their size.

    Products that fit a double's 53 bits are summed there, those that fit 63 bits as
    integers, and others as Python integers; a score beyond 64 bits becomes the nearest one.
    """
    top = float(scale * largest + 1)
    bound = top * top * max(1, q.shape[1])
    if bound < 2.0**53:
        return (whole(q, scale) @ whole(x, scale).T).astype(np.int64)
    if bound < 2.0**62:
        return whole(q, scale).astype(np.int64) @ whole(x, scale).astype(np.int64).T
    big = lambda v: [int(c) * scale if abs(c) >= 2.0**52 else int(np.floor(c * scale)) for c in v]
    right = [big(v) for v in x]
    out = np.empty((len(q), len(x)), np.int64)
    for row, mine in enumerate(big(v) for v in q):
        for column, other in enumerate(right):
            total = sum(a * b for a, b in zip(mine, other, strict=True))
            out[row, column] = min(max(total, LEAST_LONG), LARGEST_LONG)
    return out


class Cells:
    """Pivots of the data and of the queries, and what bounds the distances between their cells.

    Vectors are scaled to components of at most 1. A data vector gets one more coordinate that
    makes all norms equal to `norm`, and a query, whose length doesn't change the order of its
    scores, is stretched to that norm: the larger the product, the smaller the distance.
    """

    def __init__(self, largest: float, norm: float, scale: int):
        self.largest, self.norm, self.scale = largest, norm, scale
        #: Rounding of a squared distance, as a distance.
        self.slack = 1e-6 * max(norm, 1e-300)
        self.pivots = self.asking = np.zeros((1, 1))
        self.radius = self.limit = np.zeros(1)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return whole(x, self.scale) / (self.largest * self.scale + 1) if self.largest < 2.0**900 else x / self.largest

    def lifted(self, x: np.ndarray) -> np.ndarray:
        y = self.scaled(x)
        return np.hstack([y, np.sqrt(np.maximum(self.norm**2 - (y**2).sum(axis=1), 0))[:, None]])

    def stretched(self, q: np.ndarray) -> np.ndarray:
        y = self.scaled(q)
        own = np.sqrt((y**2).sum(axis=1))
        y = y * (self.norm / np.where(own > 0, own, 1))[:, None]
        return np.hstack([y, np.zeros((len(y), 1))])

    def between(self) -> np.ndarray:
        """Distances of query pivots (rows) and data pivots."""
        return distances(self.asking, self.pivots)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    away = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T
    return np.sqrt(np.maximum(away, 0))


def _rows(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Columns id and vector (array<double>) of the rows that take part."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.where(
        "id is not null and vector is not null"
    ).where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def _padded(df: DataFrame, size: int) -> DataFrame:
    """Missing components at the end count as zero."""
    zeros = F.array_repeat(F.lit(0.0), F.lit(size) - F.size("vector"))
    return df.withColumn("vector", F.concat("vector", zeros))


def top_products(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 1024,
    cell_rows: int = 1024,
    group_rows: int = 1024,
    fit_rows: int = 16_384,
    seed: int = 1,
) -> DataFrame:
    """Columns query_id, rank, id and score (long): each query's `k` rows with the largest inner products.

    Components are read as floor(scale * x). Data are grouped by their nearest pivot, in cells of about
    `cell_rows` rows (at most 1024 cells), queries by pivots of their own, in groups of about `group_rows` (at
    most 1024); pivots are fitted on about `fit_rows` rows, which changes the work but never the result.
    The summary of a cell is its k + 1 smallest distances to the pivot: by the triangle inequality they
    bound how far the k-th nearest row of any query of a group can be. Groups first
    search their nearest cells, which tightens that bound; then a row is copied to those groups only
    that it can be near enough to, and each group is solved in blocks of bounded size.

    Candidates are the rows whose id is not the query's; equal scores go by the smaller id. Of equal vectors
    the k + 1 smallest ids are kept, as no query can need more. Rows with a null id, and vectors
    null or with null or non-finite components, take no part; zero vectors do. Shorter vectors
    count as if they ended in zeros. An id with several vectors gives one row, with its best score. An
    empty side gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, id long, score long"
    everything, wanted = _rows(vectors, id_col, vector_col), _rows(queries, id_col, vector_col)
    sized = lambda df: df.agg(
        F.count("*"), F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x))))
    ).first()
    (many, long, high), (asked, wide, top) = sized(everything), sized(wanted)
    if not many or not asked:
        return spark.createDataFrame([], schema)
    size = max(long, wide, 1)
    alike = Window.partitionBy("vector").orderBy("id")
    data = _padded(everything, size).distinct().withColumn("n", F.row_number().over(alike)).where(F.col("n") <= k + 1)
    data, asking = cut(data.select("id", "vector")), cut(_padded(wanted, size).distinct())

    cells = Cells(max(high or 0.0, top or 0.0) or 1.0, 1.0, scale)
    sample = fitted_rows(data, fit_rows, seed)
    cells.norm = _largest_norm(data, cells) or 1.0
    cells.slack = 1e-6 * cells.norm
    cells.pivots = k_means(cells.lifted(sample), min(1024, max(1, many // cell_rows)), seed=seed)
    heard = fitted_rows(asking, fit_rows, seed)
    cells.asking = k_means(cells.stretched(heard), min(1024, max(1, asked // group_rows)), seed=seed)
    placed = cut(_placed(data, cells, False))
    grouped = cut(_placed(asking, cells, True))
    found = grouped.groupBy("cell").agg(F.max("away")).collect()
    cells.radius = np.full(len(cells.asking), -np.inf)
    for group, away in found:
        cells.radius[group] = away
    nearest_cells = _bound(placed, cells, k)

    first = _solved(placed, grouped.withColumn("best", F.lit(LEAST_LONG)), cells, k, nearest_cells)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    kth = _merged(first).withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
    kth = kth.select(F.col("query_id").alias("id"), F.col("score").alias("best"))
    bounded = cut(grouped.join(kth, "id", "left").withColumn("best", F.coalesce("best", F.lit(LEAST_LONG))))
    _tighten(bounded, cells)
    solved = _solved(placed, bounded, cells, k, None)
    return (
        _merged(solved).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "id", "score")
    )


def _merged(found: DataFrame) -> DataFrame:
    return found.groupBy("query_id", "id").agg(F.max("score").alias("score"))


def _largest_norm(data: DataFrame, cells: Cells) -> float:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        y = cells.scaled(matrix(batch.column(0)))
        return pa.RecordBatch.from_arrays([pa.array(np.sqrt((y**2).sum(axis=1)))], ["norm"])

    return over_batches(data.select("vector"), work, "norm double").agg(F.max("norm")).first()[0]


def _placed(rows: DataFrame, cells: Cells, query: bool) -> DataFrame:
    """Adds the cell (group, for queries) of the nearest pivot and the distance to it."""
    sent = rows.sparkSession.sparkContext.broadcast(cells)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        cells, x = sent.value, matrix(batch.column(1))
        away = distances(cells.stretched(x), cells.asking) if query else distances(cells.lifted(x), cells.pivots)
        near = away.argmin(axis=1)
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(near, pa.int32()), pa.array(away[np.arange(len(x)), near])],
            ["id", "vector", "cell", "away"],
        )

    return over_batches(rows.select("id", "vector"), work, "id long, vector array<double>, cell int, away double")


def _bound(placed: DataFrame, cells: Cells, k: int) -> np.ndarray:
    """Sets each group's limit from the cells' summaries; gives the cells (columns) that a group (row) tries first.

    Any k + 1 rows with different ids bound the distance of the k-th other row. A summary is at
    most k + 1 rows of each of at most 1024 cells.
    """
    by = Window.partitionBy("cell").orderBy("away", "id")
    rows = placed.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k + 1).select("cell", "away", "id").collect()
    cell = np.array([r.cell for r in rows])
    away, ids = np.array([r.away for r in rows]), np.array([r.id for r in rows])
    between = cells.between()
    cells.limit = np.full(len(between), np.inf)
    tried = np.zeros(between.shape, bool)
    held = np.bincount(cell, minlength=between.shape[1])
    for group, line in enumerate(between):
        reach = line[cell] + cells.radius[group] + away
        order = np.argsort(reach, kind="stable")
        _, seen = np.unique(ids[order], return_index=True)
        if len(seen) > k:
            cells.limit[group] = reach[order][np.sort(seen)[k]]
        near = np.argsort(line, kind="stable")
        tried[group, near[: 1 + int(np.searchsorted(np.cumsum(held[near]), 4 * (k + 1)))]] = True
    return tried


def _tighten(bounded: DataFrame, cells: Cells) -> None:
    """Lowers each group's limit to the distance at which its queries' k-th score lies."""
    sent = bounded.sparkSession.sparkContext.broadcast(cells)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        cells, x, best = sent.value, matrix(batch.column(0)), batch.column(2).to_numpy()
        unit = cells.largest * cells.scale + 1
        y = cells.scaled(x)
        own = np.sqrt((y**2).sum(axis=1))
        # Zero queries are as far from all rows; nothing can be left out for them.
        product = np.where(own > 0, cells.norm / np.where(own > 0, own, 1), 0) * (best / unit / unit)
        away = np.sqrt(np.maximum(np.where(own > 0, cells.norm**2, 0) + cells.norm**2 - 2 * product, 0))
        away = np.where((best == LEAST_LONG) | (best == LARGEST_LONG), np.inf, away)
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(away)], ["cell", "away"])

    rows = bounded.select("vector", "cell", "best")
    for group, away in over_batches(rows, work, "cell int, away double").groupBy("cell").agg(F.max("away")).collect():
        cells.limit[group] = min(cells.limit[group], away)


def _solved(placed: DataFrame, asking: DataFrame, cells: Cells, k: int, tried: np.ndarray | None) -> DataFrame:
    """The best `k` ids of each query among the rows of cells in `tried`, or (None) among all that may count.

    Of a query's rows only scores of at least its column `best` come back.
    """
    sent = placed.sparkSession.sparkContext.broadcast((cells, tried))

    def copy(batch: pa.RecordBatch) -> pa.RecordBatch:
        cells, tried = sent.value
        cell, away = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        if tried is None:
            between = cells.between()[:, cell]
            least = np.maximum(between - away, away - between) - cells.radius[:, None]
            goes = (least <= (cells.limit + cells.slack)[:, None]) & np.isfinite(cells.radius)[:, None]
        else:
            goes = tried[:, cell]
        group, row = np.nonzero(goes)
        at = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), pa.array(group, pa.int32())], ["id", "vector", "cell"]
        )

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            cells, _ = sent.value
            x, ids = matrix(left.column("vector")), left.column("id").to_numpy()
            q, own = matrix(right.column("vector")), right.column("id").to_numpy()
            best = right.column("best").to_numpy()
            once = len(np.unique(ids)) == len(ids)
            for n in range(0, len(q), SIDE):
                part = slice(n, n + SIDE)
                got = scores(q[part], x, cells.scale, cells.largest)
                out.append(_best(got, own[part], best[part], ids, k, once))
        join = lambda n: pa.array(np.concatenate([o[n] for o in out]) if out else [], pa.int64())
        return pa.table({"query_id": join(0), "id": join(1), "score": join(2)})

    copies = over_batches(placed, copy, "id long, vector array<double>, cell int")
    return met(copies, asking.select("id", "vector", "cell", "best"), "cell", solve, FOUND)


def _best(got: np.ndarray, own: np.ndarray, best: np.ndarray, ids: np.ndarray, k: int, once: bool):
    """Per row of `got` the k best ids, ties to the smaller one: query ids, ids, scores."""
    least = best
    if once and got.shape[1] > k + 1:
        # The k + 1 largest hold the k largest of others than the query itself.
        place = got.shape[1] - k - 1
        least = np.maximum(best, np.partition(got, place, axis=1)[:, place])
    row, at = np.nonzero((got >= least[:, None]) & (own[:, None] != ids))
    score, who = got[row, at], ids[at]
    if not once:
        # Descending by ~score, not -score: the least long has no opposite.
        order = np.lexsort((~score, who, row))
        row, score, who = row[order], score[order], who[order]
        new = np.append(True, (row[1:] != row[:-1]) | (who[1:] != who[:-1]))[: len(row)]
        row, score, who = row[new], score[new], who[new]
    order = np.lexsort((who, ~score, row))
    row, score, who = row[order], score[order], who[order]
    begin = np.searchsorted(row, np.arange(len(got)))
    kept = np.arange(len(row)) - begin[row] < k
    return own[row[kept]], who[kept], score[kept]
