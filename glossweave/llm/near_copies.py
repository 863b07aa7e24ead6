"""Near copies by SimHash: blocks of fingerprints, Hamming distance, and an exact check of shingle similarity.

As in op3, a text's 64-bit fingerprint is cut into blocks, texts meet under each choice of blocks, and
their Hamming distance is verified. That finds all pairs within four bits; texts of similarity 0.8 differ in
some ten. For those, parts of the shingle set are further pigeonholes: shingles are dealt to parts by their hash,
texts that share most shingles have parts in common, and those meet too. What either
way finds is checked exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.llm.common import cut, over_batches, written
from glossweave.llm.components import connected_components
from glossweave.llm.pairing import sliced, spanning_links
from glossweave.llm.simhash import fingerprint_links, fold_bits, shingle_hashes

#: Parts of a text that are filed, of all the parts that its shingles are dealt to.
PARTS = 16
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Differing bits of 128 up to which a pair is checked; texts of similarity 0.8 differ in 19
#: on average, with a standard deviation of 4, unrelated texts in 64.
NEAR_BITS = 34


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def part_keys(shingles: np.ndarray, similarity: float) -> np.ndarray:
    """Keys of the filed parts of a set of shingle hashes (sorted, different).

    The number of parts is a power of two between a quarter and half of the set's size, so
    that a part has two to four shingles. A similar set can be larger by 1 / similarity; where
    that crosses a power of two, the set is filed under both numbers. A pair of similarity 0.8
    then has at least one of its 16 parts equal with a probability over 0.999.
    """
    out = []
    largest = int(np.ceil(len(shingles) / similarity))
    for power in sorted({max(4, int(n).bit_length() - 2) for n in (len(shingles), largest)}):
        part = shingles & np.uint64((1 << power) - 1)
        filed = part < PARTS
        sums = np.zeros(PARTS, np.uint64)
        np.add.at(sums, part[filed].astype(np.int64), _mixed(shingles[filed]))
        used = np.unique(part[filed]).astype(np.int64)
        out.append(_mixed(sums[used] ^ _mixed(np.uint64(power * PARTS + 1) * MIX + used.astype(np.uint64))))
    return np.concatenate(out)


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """Columns id, n (different shingles), same (equal for equal sets), fp, fp2, keys."""
    schema = pa.schema([
        ("id", pa.int64()), ("n", pa.int64()), ("same", pa.int64()), ("fp", pa.int64()),
        ("fp2", pa.int64()), ("keys", pa.list_(pa.int64())),
    ])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column(1):
            h = np.unique(shingle_hashes(text.as_py(), words))
            same = int(_mixed(h).sum(dtype=np.uint64).astype(np.int64)) if len(h) else 0
            keys = part_keys(h, similarity).astype(np.int64) if len(h) else []
            rows.append((len(h), same, fold_bits(h), fold_bits(_mixed(h)), keys))
        columns = [pa.array([r[k] for r in rows], schema.field(k + 1).type) for k in range(5)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=schema)

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return over_batches(rows, work, "id long, n long, same long, fp long, fp2 long, keys array<long>")


def _hopeful(similarity: float):
    def near(c: dict, i, j) -> np.ndarray:
        bits = sum(np.bitwise_count(c[k].view(np.uint64)[i] ^ c[k].view(np.uint64)[j]) for k in ("fp", "fp2"))
        small, large = np.minimum(c["n"][i], c["n"][j]), np.maximum(c["n"][i], c["n"][j])
        return (bits <= NEAR_BITS) & (small >= similarity * large)

    return near


def _similar(similarity: float):
    hopeful = _hopeful(similarity)

    def near(c: dict, i, j) -> np.ndarray:
        out = hopeful(c, i, j)
        sets = c["shingles"]
        left = np.broadcast_to(i, out.shape)
        for k in np.flatnonzero(out):
            a, b = (np.frombuffer(sets[x], np.uint32) for x in (left[k], j[k]))
            both = len(np.intersect1d(a, b, assume_unique=True))
            out[k] = both >= similarity * (len(a) + len(b) - both)
        return out

    return near


def near_copy_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    similarity: float = 0.8,
    slice_rows: int = 1024,
) -> DataFrame:
    """Columns id and component (the smallest id of the group) of rows that have a near copy.

    Two texts are near copies if the Jaccard similarity of their sets of `words`-word shingles
    is at least `similarity`; groups are connected components. Equal sets fold into one row
    first. Blocks of fingerprints and of parts give candidate groups, whose shingle sets are then compared exactly in
    slices of bounded size. Texts without words and rows with a null id have no near copy; a
    table without near copies gives an empty result; extra columns are not read.
    """
    marks = cut(sketches(docs, id_col, text_col, words, similarity).where("n > 0 and id is not null"))
    folded = marks.groupBy("same", "n").agg(F.min("id").alias("id"), *[F.first(k).alias(k) for k in ("fp", "fp2")])
    first = marks.join(folded.select("id"), "id", "left_semi")
    rows = first.select("id", "n", "fp", "fp2", F.explode("keys").alias("key")).distinct()
    filed = sliced(rows, "key", "id", 4 * slice_rows).drop("key")
    close = fingerprint_links(folded.select("id", "fp")).unionByName(spanning_links(filed, _hopeful(similarity)))
    candidates = connected_components(written(close.distinct()), "a", "b")
    candidates = written(candidates.withColumnsRenamed({"node": "id", "component": "key"}))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [
            np.unique((np.unique(shingle_hashes(t.as_py(), words)) >> np.uint64(32)).astype(np.uint32)).tobytes()
            for t in batch.column(1)
        ]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sets = over_batches(texts.join(candidates.select("id"), "id", "left_semi"), work, "id long, shingles binary")
    sets = sets.join(candidates, "id").join(folded.select("id", "n", "fp", "fp2"), "id")
    compared = sliced(cut(sets), "key", "id", slice_rows).drop("key")
    groups = connected_components(spanning_links(compared, _similar(similarity)), "a", "b")
    all_ids = marks.select("id", "same", "n").join(
        folded.select("same", "n", F.col("id").alias("node")), ["same", "n"]
    )
    return (
        all_ids.join(groups, "node", "left")
        .select("id", F.coalesce("component", "node").alias("component"))
        .where("id <> component").distinct()
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """`docs` without the rows that are near copies of a row with a smaller id.

    Rows that repeat an id and its text are one document and stay once; rows with a null id stay.
    """
    gone = written(near_copy_groups(docs, id_col, text_col, **limits).select(F.col("id").alias(id_col)))
    repeated = written(
        docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col)
    )
    if repeated.isEmpty():
        return docs.join(gone, id_col, "left_anti").select(*docs.columns)
    kept = docs.join(gone, id_col, "left_anti")
    once = kept.join(repeated, id_col, "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(repeated, id_col, "left_anti").unionByName(once).select(*docs.columns)
