"""Nearest neighbours by stable projections: few dimensions, a kd-tree, a chi-square stop."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossweave.llm.blockwise import fitted_rows, matrix, met, usable
from glossweave.llm.common import cut, over_batches

#: Projected neighbours verified first, then this many times as many, and so on.
FIRST, MORE = 128, 8
#: Queries whose distances are worked out side by side.
SIDE = 256


def chi_square(x: float, dims: int) -> float:
    """P(X <= x) for chi-square with an even number of degrees of freedom."""
    half = x / 2
    return 1 - math.exp(-half) * sum(half**i / math.factorial(i) for i in range(dims // 2))


def chi_square_point(p: float, dims: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, dims) < p else (low, middle)
    return high


class Tree:
    """A kd-tree over projected points: node n splits `axes[n]` at `places[n]`; children 2n+1, 2n+2."""

    def __init__(self, sample: np.ndarray, depth: int):
        nodes = (1 << depth) - 1
        self.depth, self.axes, self.places = depth, np.zeros(nodes, int), np.zeros(nodes)
        self._split(0, sample)

    def _split(self, node: int, points: np.ndarray) -> None:
        if node >= len(self.axes):
            return
        if len(points):
            axis = int(np.ptp(points, axis=0).argmax())
            self.axes[node], self.places[node] = axis, np.median(points[:, axis])
        left = points[:, self.axes[node]] <= self.places[node]
        self._split(2 * node + 1, points[left])
        self._split(2 * node + 2, points[~left])

    def cells(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), int)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.axes[node]] > self.places[node]
            node = 2 * node + 1 + right
        return node - len(self.axes)


class Index:
    """Projection, tree, and the box of projected points of each cell."""

    def __init__(self, largest: float, projection: np.ndarray, tree: Tree):
        self.largest, self.projection, self.tree = largest, projection, tree
        self.low = self.high = np.zeros((0, 0))

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """One more coordinate makes all norms equal, so that the nearest have the largest product."""
        rest = np.sqrt(np.maximum(self.largest**2 - (x**2).sum(axis=1), 0))
        return np.hstack([x, rest[:, None]])

    def project(self, x: np.ndarray, query: bool) -> np.ndarray:
        full = np.hstack([x, np.zeros((len(x), 1))]) if query else self.lifted(x)
        return full @ self.projection

    def box_distances(self, projected: np.ndarray) -> np.ndarray:
        """Squared distance of each projected query to each cell's box (infinite: empty cell)."""
        out = np.zeros((len(projected), len(self.low)))
        for axis in range(projected.shape[1]):
            at = projected[:, axis : axis + 1]
            out += np.maximum(np.maximum(self.low[:, axis] - at, at - self.high[:, axis]), 0) ** 2
        return out


def _verified(
    index: Index, stop: float, k: int, points: dict, queries: dict
) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per query: its number and the places and products of its best points of one block.

    Projected neighbours are verified in growing shells, nearest first, until the
    next one is so far that, if it were nearer than the k-th found, its projection would have
    come earlier with the asked probability: projected distance > stop * k-th distance.
    """
    out = []
    x, px, ids = points["x"], points["p"], points["id"]
    for begin in range(0, len(queries["id"]), SIDE):
        q, pq, own, best = (queries[n][begin : begin + SIDE] for n in ("x", "p", "id", "best"))
        base = (q**2).sum(axis=1) + index.largest**2
        # Rounding of products and squares, whatever the size of the vectors.
        slack = 1e-9 * base
        away = (pq**2).sum(axis=1)[:, None] + (px**2).sum(axis=1) - 2 * pq @ px.T
        away[own[:, None] == ids] = np.inf
        product = np.full(away.shape, -np.inf)
        best = best.copy()
        inner = np.full(len(q), -np.inf)
        size = FIRST
        while True:
            reach = stop * (np.maximum(base - 2 * best, 0) + slack)
            last = size >= away.shape[1]
            outer = np.full(len(q), np.inf) if last else np.partition(away, size - 1, axis=1)[:, size - 1]
            shell = (away > inner[:, None]) & (away <= np.minimum(outer, reach)[:, None]) & np.isfinite(away)
            if shell.any():
                asked = np.flatnonzero(shell.any(axis=0))
                found = q @ x[asked].T
                product[:, asked] = np.where(shell[:, asked], found, product[:, asked])
                if product.shape[1] >= k:
                    kth = np.partition(product, product.shape[1] - k, axis=1)[:, product.shape[1] - k]
                    best = np.maximum(best, kth)
            inner, size = outer, size * MORE
            if last or (inner > stop * (np.maximum(base - 2 * best, 0) + slack)).all():
                break
        for n in range(len(q)):
            have = np.flatnonzero(product[n] > -np.inf)
            have = have[product[n, have] >= best[n] - slack[n]]
            exact = (x[have] * q[n]).sum(axis=1)
            order = np.lexsort((ids[have], -exact))[:k]
            out.append((begin + n, have[order], exact[order]))
    return out


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dims: int = 8,
    certainty: float = 0.98,
    cell_rows: int = 2048,
    fit_rows: int = 20_000,
    seed: int = 1,
) -> DataFrame:
    """Columns query_id, rank, id and score: the `k` rows with the largest inner products.

    Candidates are all rows of `vectors` whose id is not the query's; ties go to the smaller id. Vectors are
    lifted to one norm and projected to `dims` (even) Gaussian directions. The tree is
    fitted on about `fit_rows` rows, its cells (at most 4096) hold all rows, each with the box of its
    points. A query first searches the cell it falls into; its k-th product there bounds how
    far any true neighbour's projection may be, with probability `certainty` each, and so
    which cells it visits next. Rows that usable() leaves out take no part; an empty
    side gives an empty result. Extra columns are not read.
    """
    base = cut(usable(vectors, id_col, vector_col))
    asked = usable(queries, id_col, vector_col)
    schema = "query_id long, rank int, id long, score double"
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    many, largest = base.agg(F.count("*"), F.max(norm)).first()
    if not many:
        return base.sparkSession.createDataFrame([], schema)
    sample = fitted_rows(base, fit_rows, seed)
    directions = np.random.default_rng(seed).normal(size=(sample.shape[1] + 1, dims))
    depth = min(12, max(0, math.ceil(math.log2(many / cell_rows))))
    index = Index(largest, directions, Tree(np.zeros((0, dims)), 0))
    index.tree = Tree(index.project(sample, False), depth)
    placed = cut(_placed(base, index, False))
    _fit_boxes(index, placed)
    asked = cut(_placed(asked, index, True))
    stop = chi_square_point(certainty, dims)

    first = _searched(placed, asked.withColumn("best", F.lit(-1e300)), index, stop, k)
    bound = first.where(F.col("rank") == k).groupBy("query_id").agg(F.max("score").alias("best"))
    bounded = asked.drop("cell").join(bound.withColumnRenamed("query_id", "id"), "id", "left").select(
        "id", "vector", F.coalesce("best", F.lit(-1e300)).alias("best")
    )
    second = _searched(placed, _routed(bounded, index, stop), index, stop, k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        second.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "id", "score")
    )


def _placed(rows: DataFrame, index: Index, query: bool) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(index)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        cells = sent.value.tree.cells(sent.value.project(matrix(batch.column(1)), query))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32())], ["id", "vector", "cell"])

    return over_batches(rows.select("id", "vector"), work, "id long, vector array<double>, cell int")


def _fit_boxes(index: Index, placed: DataFrame) -> None:
    """Exact bounds of the projections of all points of each cell, at most 4096 rows."""
    sent = placed.sparkSession.sparkContext.broadcast(index)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, cell = sent.value.project(matrix(batch.column(1)), False), batch.column(2).to_numpy()
        names = np.unique(cell)
        low = [at[cell == c].min(axis=0).tolist() for c in names]
        high = [at[cell == c].max(axis=0).tolist() for c in names]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(low), pa.array(high)], ["cell", "low", "high"])

    parts = over_batches(placed, work, "cell int, low array<double>, high array<double>")
    dims = index.projection.shape[1]
    found = parts.groupBy("cell").agg(
        *[F.min(F.col("low")[a]).alias(f"low{a}") for a in range(dims)],
        *[F.max(F.col("high")[a]).alias(f"high{a}") for a in range(dims)],
    ).collect()
    index.low = np.full((1 << index.tree.depth, dims), np.inf)
    index.high = np.full((1 << index.tree.depth, dims), -np.inf)
    for row in found:
        index.low[row["cell"]], index.high[row["cell"]] = row[1 : dims + 1], row[dims + 1 :]


def _routed(queries: DataFrame, index: Index, stop: float) -> DataFrame:
    """Queries once for each cell whose box is within reach of their bound."""
    sent = queries.sparkSession.sparkContext.broadcast(index)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        index, x = sent.value, matrix(batch.column(1))
        best = batch.column(2).to_numpy()
        base = (x**2).sum(axis=1) + index.largest**2
        reach = stop * (np.maximum(base - 2 * best, 0) + 1e-9 * base)
        row, cell = np.nonzero(index.box_distances(index.project(x, True)) <= reach[:, None])
        return pa.RecordBatch.from_arrays(
            [*(c.take(pa.array(row)) for c in batch.columns), pa.array(cell, pa.int32())], ["id", "vector", "best", "cell"]
        )

    return over_batches(queries, work, "id long, vector array<double>, best double, cell int")


def _searched(points: DataFrame, queries: DataFrame, index: Index, stop: float, k: int) -> DataFrame:
    sent = points.sparkSession.sparkContext.broadcast(index)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            found = []
        else:
            index = sent.value
            sides = []
            for table, query in ((left, False), (right, True)):
                x = matrix(table.column("vector"))
                sides.append({"id": table.column("id").to_numpy(), "x": x, "p": index.project(x, query)})
            sides[1]["best"] = right.column("best").to_numpy()
            found = _verified(index, stop, k, *sides)
        query = [np.full(len(at), sides[1]["id"][n]) for n, at, _ in found]
        rank = [np.arange(1, len(at) + 1) for _, at, _ in found]
        ids = [sides[0]["id"][at] for _, at, _ in found]
        score = [s for _, _, s in found]
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        return pa.table({
            "query_id": join(query, pa.int64()), "rank": join(rank, pa.int32()),
            "id": join(ids, pa.int64()), "score": join(score, pa.float64()),
        })

    return met(points, queries, "cell", work, "query_id long, rank int, id long, score double")
