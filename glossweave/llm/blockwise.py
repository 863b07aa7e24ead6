"""Meet points and queries of one cell in tasks of bounded size, and vectors as arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.llm.common import ship, written

#: Rows of a task on the side of the points and of the queries.
BLOCK_ROWS = 2048
CHUNK_ROWS = 2048


def usable(vectors: DataFrame, id_col: str, vector_col: str, *more: str) -> DataFrame:
    """Columns id, vector (array<double>) and `more` of rows that can take part.

    These have an id and a vector of the most frequent size that is not all zero and
    holds neither nulls nor NaN nor infinities.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), *more
    ).where("id is not null and vector is not null")
    rows = rows.where(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (sizes[0] if sizes else 0))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long lists of doubles as a matrix."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = [np.asarray(c.flatten(), float).reshape(len(c), -1) for c in chunks if len(c)]
    return np.concatenate(parts) if parts else np.zeros((0, 0))


def fitted_rows(rows: DataFrame, bound: int, seed: int) -> np.ndarray:
    """About `bound` vectors picked by a hash of their id (all, if fewer), in order of id."""
    share = min(1.0, bound / max(rows.count(), 1))
    picked = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))
    sample = (rows.where(picked) if share < 1 else rows).limit(2 * bound).select("id", "vector").toArrow()
    values = matrix(sample.column("vector"))
    return values[np.argsort(sample.column("id").to_numpy(), kind="stable")]


def met(
    points: DataFrame,
    queries: DataFrame,
    cell: str,
    work: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
) -> DataFrame:
    """work(points, queries) of each cell that has both, in blocks.

    Points of a cell are cut by a hash of their id into blocks of about BLOCK_ROWS, queries into chunks
    of about CHUNK_ROWS, and every block meets every chunk in a task of its own, so that no
    cell, however large, is one group. Both sides have the columns `cell` and id.
    """
    ship(points.sparkSession)
    count = lambda df, name, rows: df.groupBy(cell).agg(F.ceil(F.count("*") / rows).cast("int").alias(name))
    plan = written(count(points, "blocks", BLOCK_ROWS).join(count(queries, "chunks", CHUNK_ROWS), cell))
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    part = lambda name: F.pmod(F.xxhash64("id"), F.col(name)).cast("int")
    keys = [cell, "block", "chunk"]
    many = max(1, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left = points.join(plan, cell).select(*points.columns, part("blocks").alias("block"), every("chunks").alias("chunk"))
    right = queries.join(plan, cell).select(*queries.columns, part("chunks").alias("chunk"), every("blocks").alias("block"))
    pairs = left.repartition(many, *keys).groupBy(*keys).cogroup(right.repartition(many, *keys).groupBy(*keys))
    return pairs.applyInArrow(work, schema)
