"""Session settings the library relies on; none of them is tied to a machine."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
#: Steps over more bytes go in several turns, at most so many.
SLICE_BYTES = 16 << 20
MOST_SLICES = 8
_CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tune(spark: SparkSession) -> SparkSession:
    """Turn on the run-time re-planning that the joins count on.

    Joins here name no broadcast side unless it is a fixed list, so AQE sees the real
    sizes and picks broadcast, hash or sort-merge; a key that holds a large share of
    the rows is split by the skew rule, also when that costs one more shuffle.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and go on from there.

    Used after steps that must not run twice (calls of a user's model). The folder is
    the one the cluster names; a temporary one is set only in local mode.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Like `cut`, but as a Parquet table, whose real size the planner knows."""
    spark = df.sparkSession
    path = f"{_shared_folder(spark).rstrip('/')}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.parquet(path)


@dataclass
class Stored:
    """A table between steps; see `stored`."""

    table: DataFrame
    path: str

    def _at(self, part: str = "") -> tuple:
        spark = self.table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}" if part else self.path)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def size(self) -> int:
        """Bytes of its files."""
        files, path = self._at()
        return files.getContentSummary(path).getLength()

    def drop(self, part: str = "") -> None:
        """Delete the table, or one folder of it, once nothing reads it any more."""
        files, path = self._at(part)
        files.delete(path, True)


def stored(df: DataFrame, *parts: str) -> Stored:
    """Like `written`, for whole texts: pressed harder, and what the job shuffled goes with its end.

    `parts` are columns that the table is split by into folders.
    """
    spark = df.sparkSession
    path = f"{_shared_folder(spark).rstrip('/')}/table-{uuid.uuid4()}"
    with _shuffles_removed(spark):
        df.write.partitionBy(*parts).option("compression", "zstd").parquet(path)
    # A table without rows has no folders to read the schema from.
    return Stored(spark.read.schema(df.schema).parquet(path), path)


def stored_in_turn(spark: SparkSession, frames: Iterator[DataFrame]) -> DataFrame:
    """One table of frames of equal columns, each written before the next one is asked for.

    Only one of them has shuffle files at a time; a generator may drop what it has read.
    """
    path = f"{_shared_folder(spark).rstrip('/')}/table-{uuid.uuid4()}"
    schema = None
    for df in frames:
        with _shuffles_removed(spark):
            df.write.mode("append").option("compression", "zstd").parquet(path)
        schema = df.schema
    return spark.read.schema(schema).parquet(path)


def slices_of(*tables: Stored) -> int:
    """In how many turns a step goes over its tables, by their bytes."""
    return min(max(-(-sum(t.size() for t in tables) // SLICE_BYTES), 1), MOST_SLICES)


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs inside are deleted at their end, not when the driver collects garbage."""
    before = spark.conf.get(_CLEANUP_SETTING, None)
    spark.conf.set(_CLEANUP_SETTING, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP_SETTING)
        else:
            spark.conf.set(_CLEANUP_SETTING, before)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows over the shuffle partitions, which are not merged again.

    For rows that are few and small before a step that makes many of each: the size rule
    would put them all into one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get(CHECKPOINT_SETTING, None)
        if named is None:
            if not context.master.startswith("local"):
                raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
            named = tempfile.mkdtemp(prefix="glossweave-checkpoint-")
        context.setCheckpointDir(named)
    return str(context.getCheckpointDir())
