"""Find links among rows that share a key, with bounded work per task and few rows out.

A key's rows never become a table of pairs. A task looks at one key, or at two slices of a
key that has more than `slice_rows` rows, and gives back a spanning forest of the links that
it saw: enough to keep every connected component whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.llm.common import drop_kept, ship

#: Groups up to this size are compared all at once by shifting; larger ones row by row.
SMALL = 24


def sliced(rows: DataFrame, key: str, row_id: str, slice_rows: int) -> DataFrame:
    """`rows` with a column `task`: all rows of a key, or of two slices of a large key.

    Keys with more than `slice_rows` rows are cut into slices by a hash of `row_id`, and each
    row goes to the tasks of its slice with every slice of the key, so that any two rows of a
    key meet in some task and a task has at most about twice `slice_rows` rows.
    """
    large = (
        rows.groupBy(key).count().where(F.col("count") > slice_rows)
        .select(F.col(key), F.ceil(F.col("count") / slice_rows).cast("int").alias("slices"))
    )
    marked = rows.join(large, key, "left")
    own = F.pmod(F.xxhash64(row_id), F.col("slices")).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("slices") - 1),
        lambda x: F.xxhash64(F.col(key), F.least(x, own), F.greatest(x, own)),
    )
    tasks = F.when(F.col("slices").isNull(), F.array(F.col(key))).otherwise(others)
    return marked.select(*rows.columns, F.explode(tasks).alias("task"))


def spanning_links(
    rows: DataFrame,
    near: Callable[[dict, np.ndarray, np.ndarray], np.ndarray],
    schema: str = "a long, b long",
) -> DataFrame:
    """Links a, b between rows of one task: a spanning forest of what `near` accepts.

    `rows` has the columns task, id (long) and whatever `near` needs. near(columns, i, j)
    gets all columns of a stretch of rows as arrays and two arrays of row numbers (or one
    number and an array) and says which of these pairs are linked.
    """

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray]]:
        """Stretches of whole groups and the places where groups begin."""
        rest = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([rest, now]).combine_chunks() if rest is not None else now
            task = now.column("task").to_numpy()
            edge = np.flatnonzero(task[1:] != task[:-1]) + 1
            last = int(edge[-1]) if len(edge) else 0
            if last:
                yield _arrays(now.slice(0, last)), np.append(0, edge[:-1])
            rest = now.slice(last)
        if rest is not None and rest.num_rows:
            yield _arrays(rest), np.array([0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for columns, begins in groups(batches):
            found = list(_links(columns, begins, near))
            a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1)) if found else ([], [])
            ids = columns["id"]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    ship(rows.sparkSession)
    return (
        rows.repartition("task").sortWithinPartitions("task").mapInArrow(run, schema)
    )


def _arrays(table: pa.Table) -> dict:
    return {n: table.column(n).to_numpy() for n in table.column_names}


def _links(columns: dict, begins: np.ndarray, near) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    total = len(columns["task"])
    sizes = np.diff(np.append(begins, total))
    group = np.repeat(np.arange(len(begins)), sizes)
    small = np.repeat(sizes <= SMALL, sizes)
    for step in range(1, min(SMALL, int(sizes.max(initial=1)))):
        i = np.flatnonzero((group[step:] == group[:-step]) & small[step:])
        if not len(i):
            break
        i = i[near(columns, i, i + step)]
        if len(i):
            yield i, i + step
    for begin, size in zip(begins[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        yield from _forest(columns, int(begin), int(size), near)


def _forest(columns: dict, begin: int, size: int, near) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Breadth-first over one large group: each row is compared with rows not reached yet."""
    left = np.arange(begin, begin + size)
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = near(columns, at, left)
            if hit.any():
                new = left[hit]
                yield np.full(len(new), at), new
                queue.extend(new)
                left = left[~hit]
