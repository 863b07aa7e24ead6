"""Batch plans: fixed-size, and bounded by characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.functions import patterns as P
from glossweave.plans.scan import BLOCK_ROWS, block, row_numbers

SPAN_BLOCKS = 1024


def fixed_batches(
    items: DataFrame, keys: list[str], order: str, size: Column | int,
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Number batches of `size` items each, from 0, per group."""
    size = F.lit(size) if isinstance(size, int) else size
    numbered = row_numbers(items, keys, order, "_n", rows)
    return numbered.withColumn(
        "batch_no", F.floor((F.col("_n") - 1) / size).cast("long")
    ).drop("_n")


def tier_batch_size(tier: Column) -> Column:
    size = None
    for name, n in P.BATCH_SIZES.items():
        size = F.when(tier == name, n) if size is None else size.when(tier == name, n)
    return size.otherwise(1)


# --------------------------------------------------------------------------------------
# Greedy batches by characters. A batch closes when the next item would take it over the
# limit, so each cut depends on the one before: a plain window cannot say it. Groups are
# cut into blocks of positions. What a block does to the fill level it is entered with is
# a small table (one entry per fill level), so blocks of one group are summarised side by
# side, the summaries are chained, and then all blocks are numbered side by side.
# --------------------------------------------------------------------------------------


class _Cuts:
    """Where greedy batches start inside one block of lengths."""

    def __init__(self, lengths: np.ndarray, limit: int):
        self.limit = limit
        self.n = len(lengths)
        self.upto = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        reach = np.searchsorted(self.upto, self.upto[:-1] + limit, side="right") - 1
        self.next = np.maximum(reach, np.arange(1, self.n + 1))

    def first(self, fill):
        """First cut when the block is entered with an open batch of `fill` characters."""
        return np.maximum(np.searchsorted(self.upto, self.limit - fill, side="right") - 1, 0)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """(fill level on leaving, cuts made) for every way to enter.

        Levels 0..limit are open batches, limit+1 an open batch that is already over, and
        limit+2 stands for no open batch at all.
        """
        over = self.limit + 1
        cuts = np.zeros(self.n + 1, dtype=np.int64)
        start = np.zeros(self.n + 1, dtype=np.int64)
        for i in range(self.n - 1, -1, -1):
            following = self.next[i]
            cuts[i] = 1 + cuts[following]
            start[i] = i if following >= self.n else start[following]
        total = self.upto[-1]
        fills = np.arange(over + 1)
        at = self.first(fills)
        open_still = at >= self.n
        leave = np.where(open_still, fills + total, total - self.upto[start[at]])
        made = np.where(open_still, 0, cuts[at])
        leave = np.append(leave, total - self.upto[start[0]])
        made = np.append(made, cuts[0] - 1)
        return np.minimum(leave, over).astype(np.int32), made


def _runs(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole runs of equal keys from a sorted partition, also across Arrow batches."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if frame.empty:
            continue
        changed = (frame[keys] != frame[keys].shift()).any(axis=1).to_numpy()
        if held:
            changed[0] = bool((held[-1][keys].iloc[-1] != frame[keys].iloc[0]).any())
        begin = 0
        for end in [*np.flatnonzero(changed).tolist(), len(frame)]:
            if end > begin:
                held.append(frame.iloc[begin:end])
            if end < len(frame) and held:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            begin = end
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def char_batches(
    items: DataFrame,
    keys: list[str],
    order: str,
    chars: str,
    limit: int = P.BATCH_CHARS,
    rows: int = BLOCK_ROWS,
    span: int = SPAN_BLOCKS,
) -> DataFrame:
    """Number greedy batches of at most `limit` characters, from 0, per group.

    An item longer than the limit is a batch of its own. `items` should be narrow (keys,
    order, length); join the numbers back to the texts on keys and order.
    """
    none = limit + 2
    schema = items.schema
    key_ddl = ", ".join(f"`{k}` {schema[k].dataType.simpleString()}" for k in keys)
    order_ddl = f"`{order}` {schema[order].dataType.simpleString()}"
    narrow = items.select(*keys, order, F.col(chars).cast("long").alias("_chars"))
    blocked = narrow.withColumn("_block", block(order, rows))

    wide = blocked.groupBy(*keys).agg(F.max("_block").alias("_most")).where("_most > 0")

    def summarise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in _runs(frames, [*keys, "_block"]):
            leave, made = _Cuts(run["_chars"].to_numpy(), limit).table()
            head = run.iloc[[0]][[*keys, "_block"]].copy()
            head["leave"], head["made"] = [leave], [made]
            yield head

    tables = (
        blocked.join(wide.select(*keys), keys, "left_semi")
        .repartition(*keys, "_block")
        .sortWithinPartitions(*keys, "_block", order)
        .mapInPandas(summarise, f"{key_ddl}, _block long, leave array<int>, made array<long>")
        .withColumn("_span", F.floor(F.col("_block") / span).cast("long"))
    )

    def chain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in _runs(frames, [*keys, "_span"]):
            leave = np.arange(none + 1)
            made = np.zeros(none + 1, dtype=np.int64)
            for one_leave, one_made in zip(run["leave"], run["made"]):
                made = made + np.asarray(one_made)[leave]
                leave = np.asarray(one_leave)[leave]
            head = run.iloc[[0]][[*keys, "_span"]].copy()
            head["leave"], head["made"] = [leave.astype(np.int32)], [made]
            yield head

    spans = (
        tables.repartition(*keys, "_span")
        .sortWithinPartitions(*keys, "_span", "_block")
        .mapInPandas(chain, f"{key_ddl}, _span long, leave array<int>, made array<long>")
    )

    def walk(step: str, by: list[str], entered: bool):
        def run_walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            current, level, batch = None, none, 0
            for frame in frames:
                levels, batches = [], []
                for row in frame.itertuples(index=False, name=None):
                    row = dict(zip(frame.columns, row))
                    group = tuple(row[k] for k in by)
                    if group != current:
                        current = group
                        level = int(row["enter"]) if entered else none
                        batch = int(row["base"]) if entered else 0
                    levels.append(level)
                    batches.append(batch)
                    batch += int(row["made"][level])
                    level = int(row["leave"][level])
                out = frame[[*keys, step]].copy()
                out["enter"], out["base"] = levels, batches
                yield out

        return run_walk

    span_starts = (
        spans.repartition(*keys)
        .sortWithinPartitions(*keys, "_span")
        .mapInPandas(
            walk("_span", keys, False), f"{key_ddl}, _span long, enter int, base long"
        )
    )
    block_starts = (
        tables.join(span_starts, [*keys, "_span"])
        .repartition(*keys, "_span")
        .sortWithinPartitions(*keys, "_span", "_block")
        .mapInPandas(
            walk("_block", [*keys, "_span"], True),
            f"{key_ddl}, _block long, enter int, base long",
        )
    )

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # One frame in, one frame out: groups are small, frames are not.
        current, fill, batch = None, 0, 0
        for frame in frames:
            groups = zip(*[frame[k].tolist() for k in [*keys, "_block"]])
            entered, bases = frame["enter"].tolist(), frame["base"].tolist()
            numbers = []
            for n, (group, size) in enumerate(zip(groups, frame["_chars"].tolist())):
                if group != current:
                    current, fill, batch = group, entered[n], bases[n]
                    if fill == none:
                        fill = 0
                    elif fill + size > limit:
                        fill, batch = 0, batch + 1
                elif fill + size > limit:
                    fill, batch = 0, batch + 1
                fill += size
                numbers.append(batch)
            out = frame[[*keys, order]].copy()
            out["batch_no"] = numbers
            yield out

    return (
        blocked.join(block_starts, [*keys, "_block"], "left")
        .fillna({"enter": none, "base": 0})
        .repartition(*keys, "_block")
        .sortWithinPartitions(*keys, "_block", order)
        .mapInPandas(number, f"{key_ddl}, {order_ddl}, batch_no long")
    )
