"""Blocked scans and batches against plain loops, with blocks of a few rows."""

import random

from pyspark.sql import functions as F

from glossweave.operators.batching import char_batches, fixed_batches
from glossweave.plans.scan import first_rows, row_numbers, scan


def _rows(seed, groups=5, most=40, gaps=True):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        pos = 0
        for _ in range(rng.randint(1, most)):
            pos += rng.randint(1, 9) if gaps else 1
            rows.append((g, pos, rng.choice([None, 0, 1, 2, 5])))
    rng.shuffle(rows)
    return rows


def test_scan_over_blocks(spark):
    rows = _rows(1)
    df = spark.createDataFrame(rows, "g int, pos int, x int").repartition(4)
    got = scan(
        df, ["g"], "pos", totals={"total": F.coalesce("x", F.lit(0))}, last={"seen": F.col("x")},
        rows=7,
    ).collect()
    want, total, seen = {}, {}, {}
    for g, pos, x in sorted(rows, key=lambda r: r[:2]):
        before = seen.get(g)
        total[g] = total.get(g, 0) + (x or 0)
        if x is not None:
            seen[g] = x
        want[g, pos] = (total[g], before)
    assert {(r.g, r.pos): (r.total, r.seen) for r in got} == want


def test_row_numbers_and_fixed_batches(spark):
    rows = _rows(2)
    df = spark.createDataFrame(rows, "g int, pos int, x int")
    numbers = {(r.g, r.pos): r.n for r in row_numbers(df, ["g"], "pos", "n", rows=5).collect()}
    batches = {
        (r.g, r.pos): r.batch_no for r in fixed_batches(df, ["g"], "pos", 3, rows=5).collect()
    }
    counts = {}
    for g, pos, _ in sorted(rows, key=lambda r: r[:2]):
        counts[g] = counts.get(g, 0) + 1
        assert numbers[g, pos] == counts[g]
        assert batches[g, pos] == (counts[g] - 1) // 3


def _greedy(lengths, limit):
    batch, fill, open_, out = 0, 0, False, []
    for n in lengths:
        if open_ and fill + n > limit:
            batch, fill = batch + 1, 0
        open_, fill = True, fill + n
        out.append(batch)
    return out


def test_char_batches_of_long_groups(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for g in range(6):
        lengths = [rng.choice([0, 1, 4, 9, 10, 11, 25, rng.randint(0, 12)]) for _ in range(70)]
        for pos, (n, b) in enumerate(zip(lengths, _greedy(lengths, 20))):
            rows.append((g, "t", pos * 2, n))
            want[g, pos * 2] = b
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g int, tier string, pos int, n int")
    for block_rows, span in ((8, 3), (1, 2), (1000, 3)):
        got = char_batches(df, ["g", "tier"], "pos", "n", limit=20, rows=block_rows, span=span)
        assert {(r.g, r.pos): r.batch_no for r in got.collect()} == want


def test_oversized_first_item_is_a_batch_of_its_own(spark):
    df = spark.createDataFrame([(1, 0, 50), (1, 1, 3), (1, 2, 17), (1, 3, 1)], "g int, pos int, n int")
    got = char_batches(df, ["g"], "pos", "n", limit=20, rows=1, span=2)
    assert {r.pos: r.batch_no for r in got.collect()} == {0: 0, 1: 1, 2: 1, 3: 2}


def test_first_rows(spark):
    df = spark.createDataFrame(_rows(4), "g int, pos int, x int")
    assert max(r["count"] for r in first_rows(df, ["g"], [F.col("pos")], 3).groupBy("g").count().collect()) <= 3
