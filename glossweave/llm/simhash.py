"""SimHash near-duplicate detection by pigeonhole blocks."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.llm.common import cut, over_batches
from glossweave.llm.components import connected_components
from glossweave.llm.pairing import sliced, spanning_links

BITS = 64
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 15


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `words` words, repeats included.

    A-Z are lowered; words are what is between the six ASCII white-space characters. A text with fewer words
    gives one hash, of the whole sequence; a text without words gives none.
    """
    found = WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    begins = np.append(0, ends[:-1] + 1)
    first, last = begins[: max(1, len(found) - words + 1)], ends[min(words, len(found)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], 42) for a, b in zip(first.tolist(), last.tolist(), strict=True)),
        np.uint64, len(first),
    )


def fold_bits(hashes: np.ndarray) -> int:
    """The fingerprint, as a signed 64-bit number: bits set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), CHUNK):
        part = hashes[k : k + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = 4) -> DataFrame:
    """Columns id and fp (64 bits as a signed long) of every row; whole texts are read.

    Null and wordless texts get fingerprint zero. Rows are independent; repeated ids stay.
    """
    out = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        marks = [fold_bits(shingle_hashes(t.as_py(), words)) for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64())], schema=out)

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return over_batches(rows, work, "id long, fp long")


def block_masks(max_bits: int, blocks: int) -> list[int]:
    """Masks of all choices of blocks - max_bits blocks, as signed longs.

    At most `max_bits` blocks hold a differing bit, so close fingerprints agree under at
    least one of these masks.
    """
    edges = [round(k * BITS / blocks) for k in range(blocks + 1)]
    each = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(each, blocks - max_bits)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def within(max_bits: int):
    def near(columns: dict, i, j) -> np.ndarray:
        fp = columns["fp"].view(np.uint64)
        return np.bitwise_count(fp[i] ^ fp[j]) <= max_bits

    return near


def fingerprint_links(
    marks: DataFrame, max_bits: int = 4, blocks: int = 7, slice_rows: int = 4096
) -> DataFrame:
    """Links a, b between ids of `marks` (id, fp) whose fingerprints differ in few bits.

    Pigeonhole: the fingerprint is split into `blocks` blocks and every row is filed under
    each choice of blocks - max_bits of them, so a pair within `max_bits` bits meets in a
    bucket, where its Hamming distance is verified. The links are a spanning forest per
    bucket: components stay whole although no bucket is expanded into all its pairs.
    """
    keys = F.explode(
        F.array(
            *[
                F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(m)))
                for n, m in enumerate(block_masks(max_bits, blocks))
            ]
        )
    )
    rows = marks.where("id is not null").select("id", "fp", keys.alias("key"))
    return spanning_links(sliced(rows, "key", "id", slice_rows).select("task", "id", "fp"), within(max_bits))


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    max_bits: int = 4,
    blocks: int = 7,
) -> DataFrame:
    """Columns id, fp and component of every row of `docs`.

    `component` is the smallest id reachable over links between fingerprints that differ in
    at most `max_bits` bits. Rows with one fingerprint are folded before any comparison, so a
    large group of exact copies is one row. Rows with a null id keep a fingerprint and get the
    component of that fingerprint (null if no row with it has an id). An empty table gives
    an empty result; extra columns are not read.
    """
    marks = cut(fingerprints(docs, id_col, text_col, words))
    folded = marks.groupBy("fp").agg(F.min("id").alias("id"))
    labels = connected_components(fingerprint_links(folded, max_bits, blocks), "a", "b")
    group = folded.join(labels, folded.id == labels.node, "left").select(
        "fp", F.coalesce("component", "id").alias("component")
    )
    return marks.join(group, "fp").select("id", "fp", "component")


def fingerprint_text(fp: Column) -> Column:
    """The fingerprint as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
