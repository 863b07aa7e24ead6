"""Ordered scans over groups of any size.

A window over one group runs in one task, so a group that holds a large share of all
rows would stall the job. Here a group is cut into blocks of positions. Windows run per
(group, block); one narrow aggregate row per block carries the state across blocks, and
only the blocks after the first need it, so for ordinary groups the carry side is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 65536
_BLOCK = "_block"


def block(order: str, rows: int) -> Column:
    return F.floor(F.col(order) / F.lit(rows)).cast("long")


def scan(
    df: DataFrame,
    keys: list[str],
    order: str,
    totals: dict[str, Column] | None = None,
    last: dict[str, Column] | None = None,
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add running columns in the order of the integer column `order` (unique per group).

    `totals`: sum of the value up to and with this row. `last`: the latest non-null
    value before this row.
    """
    totals, last = totals or {}, last or {}
    df = df.withColumn(_BLOCK, block(order, rows))
    for name, value in {**totals, **last}.items():
        df = df.withColumn(f"_in_{name}", value)

    per_block = df.groupBy(*keys, _BLOCK).agg(
        *[F.sum(f"_in_{n}").alias(f"_sum_{n}") for n in totals],
        *[
            F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), F.col(order))).alias(
                f"_last_{n}"
            )
            for n in last
        ],
    )
    before = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(
        Window.unboundedPreceding, -1
    )
    carry = per_block.select(
        *keys,
        _BLOCK,
        *[F.sum(f"_sum_{n}").over(before).alias(f"_carry_{n}") for n in totals],
        *[
            F.last(f"_last_{n}", ignorenulls=True).over(before).alias(f"_carry_{n}")
            for n in last
        ],
    ).where(F.col(_BLOCK) > 0)

    inside = Window.partitionBy(*keys, _BLOCK).orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = df.select(
        "*",
        *[F.sum(f"_in_{n}").over(upto).alias(f"_local_{n}") for n in totals],
        *[
            F.last(f"_in_{n}", ignorenulls=True).over(earlier).alias(f"_local_{n}")
            for n in last
        ],
    )
    joined = local.join(carry, [*keys, _BLOCK], "left")
    kept = [c for c in df.columns if c != _BLOCK and not c.startswith("_in_")]
    return joined.select(
        *kept,
        *[
            (F.coalesce(f"_local_{n}", F.lit(0)) + F.coalesce(f"_carry_{n}", F.lit(0))).alias(n)
            for n in totals
        ],
        *[F.coalesce(f"_local_{n}", f"_carry_{n}").alias(n) for n in last],
    )


def running_total(
    df: DataFrame, keys: list[str], order: str, value: Column, name: str,
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    return scan(df, keys, order, totals={name: value}, rows=rows)


def row_numbers(
    df: DataFrame, keys: list[str], order: str, name: str, rows: int = BLOCK_ROWS
) -> DataFrame:
    """Dense numbers from 1 in the order of `order`."""
    return scan(df, keys, order, totals={name: F.lit(1).cast("long")}, rows=rows)


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first `n` rows of each group.

    Spark cuts every map task's rows to `n` per group before the shuffle
    (WindowGroupLimit), so a large group sends only a few rows to its task.
    """
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", number).where(F.col("_n") <= n).drop("_n")
