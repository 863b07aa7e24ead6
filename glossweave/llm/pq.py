"""Near duplicates among vectors by product quantisation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.llm.blockwise import fitted_rows, matrix, met, usable
from glossweave.llm.common import cut, over_batches
from glossweave.llm.components import connected_components


def k_means(points: np.ndarray, k: int, rounds: int = 6, seed: int = 1) -> np.ndarray:
    """At most k centroids by Lloyd's rounds; empty ones are left where they were."""
    pick = np.random.default_rng(seed)
    centres = points[np.sort(pick.choice(len(points), min(k, len(points)), replace=False))].copy()
    for _ in range(rounds):
        near = _nearest(points, centres)
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, points)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0][:, None]
    return centres


def _squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    away = (points**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * points @ centres.T
    return np.maximum(away, 0)


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return _squared(points, centres).argmin(axis=1)


class Quantiser:
    """Coarse centroids, and per subspace a codebook of what is left of a vector after its centroid."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int, codes: int):
        self.centres = k_means(sample, lists)
        rest = sample - self.centres[_nearest(sample, self.centres)]
        self.edges = np.linspace(0, sample.shape[1], min(parts, sample.shape[1]) + 1).astype(int)
        self.books = [k_means(rest[:, a:b], codes) for a, b in self.subspaces()]

    def subspaces(self):
        return list(zip(self.edges[:-1], self.edges[1:], strict=True))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, and the distance of each vector from what its codes stand for."""
        place = _nearest(x, self.centres)
        rest = x - self.centres[place]
        codes = np.stack([_nearest(rest[:, a:b], book) for (a, b), book in zip(self.subspaces(), self.books, strict=True)], axis=1)
        back = np.hstack([book[codes[:, n]] for n, book in enumerate(self.books)])
        return place, codes.astype(np.uint8), np.sqrt(((rest - back) ** 2).sum(axis=1))

    def probes(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """All (row, list) whose list may hold a vector within `radius`.

        A vector of another list lies beyond the plane halfway between the two centroids, so a
        list counts if the row is within the radius of that plane.
        """
        away = _squared(x, self.centres)
        own = away.argmin(axis=1)
        between = np.sqrt(_squared(self.centres, self.centres))[own]
        beyond = away - away[np.arange(len(x)), own][:, None]
        return np.nonzero(beyond <= 2 * between * radius + 1e-9)

    def asymmetric(self, x: np.ndarray, place: int, codes: np.ndarray) -> np.ndarray:
        """Distances of whole rows to coded vectors of one list, from tables per subspace."""
        rest = x - self.centres[place]
        total = np.zeros((len(x), len(codes)))
        for n, ((a, b), book) in enumerate(zip(self.subspaces(), self.books, strict=True)):
            total += np.take(_squared(rest[:, a:b], book), codes[:, n], axis=1)
        return np.sqrt(total)


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    group_col: str = "label",
    least: float = 0.98,
    list_rows: int = 256,
    parts: int = 8,
    codes: int = 64,
    fit_rows: int = 8_192,
) -> DataFrame:
    """Columns id, n_links and component of every row of `vectors`.

    Rows are linked if their group is equal and not null and their cosine, in double precision,
    is at least `least`; n_links counts the rows linked directly and component is the smallest
    id reachable. Equal vectors of a group fold into one row first. The quantiser is fitted on
    about `fit_rows` rows; every row is filed in the list of its coarse centroid with the
    codes of its residual and the error they make. A row probes every list that can hold a
    vector within reach; the table-lookup distance minus the error is a lower bound, so what
    it rules out is no link, and the rest is checked by exact cosine: no link is lost. Lists
    are searched in blocks of bounded size, which give counts and a spanning forest, never
    all pairs. Rows that usable() leaves out, or without a group, link with nothing. Rows that
    repeat an id stay and count as copies of each other.
    """
    spark = vectors.sparkSession
    every = vectors.select(F.col(id_col).cast("long").alias("id"))
    groups = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(group_col).cast("string").alias("grp"), F.col(vector_col).alias("v"))
    members = cut(usable(groups.where("grp is not null"), "id", "v", "grp"))
    folded = cut(members.groupBy("grp", "vector").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    kinds, many = folded.agg(F.count_distinct("grp"), F.count("*")).first()
    if not many:
        return every.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    lists = 1 << max(0, min(10, round(np.log2(max(1.0, many / (kinds * list_rows))))))
    made = Quantiser(_unit(fitted_rows(folded, fit_rows, 6)), lists, parts, codes)
    radius = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-7
    found = cut(_linked(folded, made, radius, least, spark))
    links = found.where("other is not null").select("id", "other")
    counts = found.where("other is null").groupBy("id").agg(F.sum("n").alias("n"))
    labels = connected_components(links, "id", "other").withColumnRenamed("node", "id")
    per_vector = folded.join(counts, "id", "left").join(labels, "id", "left").select(
        "grp", "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component"),
    )
    linked = members.join(per_vector, ["grp", "vector"]).groupBy(F.col("id").alias("member")).agg(
        F.max("n_links").alias("n_links"), F.min("component").alias("component")
    )
    return every.join(linked, every.id == linked.member, "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component")
    )


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x**2).sum(axis=1))[:, None]


def _linked(folded: DataFrame, made: Quantiser, radius: float, least: float, spark) -> DataFrame:
    """Rows id, n (links to other vectors, copies counted) and rows id, other (a forest of links)."""
    sent = spark.sparkContext.broadcast(made)

    def file(batch: pa.RecordBatch) -> pa.RecordBatch:
        place, codes, error = sent.value.encode(_unit(matrix(batch.column(2))))
        cells = [f"{g}\t{p}" for g, p in zip(batch.column(1).to_pylist(), place, strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), batch.column(3), pa.array(cells), pa.array(place, pa.int32()),
             pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)],
            ["id", "vector", "copies", "cell", "place", "codes", "error"],
        )

    def probe(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, place = sent.value.probes(_unit(matrix(batch.column(2))), radius)
        group = batch.column(1).to_pylist()
        cells = [f"{group[r]}\t{p}" for r, p in zip(row, place, strict=True)]
        taken = [batch.column(n).take(pa.array(row)) for n in (0, 2)]
        return pa.RecordBatch.from_arrays([*taken, pa.array(cells, pa.string())], ["id", "vector", "cell"])

    rows = folded.select("id", "grp", "vector", "copies")
    points = over_batches(
        rows, file, "id long, vector array<double>, copies long, cell string, place int, codes binary, error double"
    )
    queries = over_batches(rows, probe, "id long, vector array<double>, cell string")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        if left.num_rows and right.num_rows:
            out = _block_links(sent.value, left, right, radius, least)
        return pa.table({
            "id": pa.array(out[0], pa.int64()), "n": pa.array(out[1], pa.int64()), "other": pa.array(out[2], pa.int64())
        })

    return met(points, queries, "cell", work, "id long, n long, other long")


def _block_links(made: Quantiser, left: pa.Table, right: pa.Table, radius: float, least: float):
    x, q = _unit(matrix(left.column("vector"))), _unit(matrix(right.column("vector")))
    ids, own = left.column("id").to_numpy(), right.column("id").to_numpy()
    copies, error = left.column("copies").to_numpy(), left.column("error").to_numpy()
    codes = np.frombuffer(b"".join(left.column("codes").to_pylist()), np.uint8).reshape(len(x), -1)
    away = made.asymmetric(q, left.column("place")[0].as_py(), codes)
    row, at = np.nonzero(away - error <= radius)
    linked = np.zeros(len(row), bool)
    for k in range(0, len(row), 1 << 17):
        part = slice(k, k + (1 << 17))
        linked[part] = np.einsum("nd,nd->n", q[row[part]], x[at[part]]) >= least
    linked &= own[row] != ids[at]
    row, at = row[linked], at[linked]
    counted = np.bincount(row, weights=copies[at], minlength=len(q)).astype(np.int64)
    some = np.flatnonzero(counted)
    out_id, out_n, out_other = own[some].tolist(), counted[some].tolist(), [None] * len(some)
    # One link per set of points that no link so far has joined: a spanning forest.
    root: dict[int, int] = {}

    def find(a: int) -> int:
        while root.setdefault(a, a) != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    owner = np.full(len(x), -1)
    edges = np.append(np.flatnonzero(np.diff(row, prepend=-1)), len(row))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        mine, points = int(row[a]), at[a:b]
        new = points[owner[points] < 0]
        held, first = np.unique(owner[points[owner[points] >= 0]], return_index=True)
        picks = points[owner[points] >= 0][first]
        joins = []
        for o, p in zip(held.tolist(), picks.tolist(), strict=True):
            if find(o) != find(mine):
                root[find(o)] = find(mine)
                joins.append(p)
        owner[new] = mine
        for p in [*new.tolist(), *joins]:
            out_id.append(int(own[mine]))
            out_n.append(0)
            out_other.append(int(ids[p]))
    return out_id, out_n, out_other
