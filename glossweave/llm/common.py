"""Small helpers that the operators of this package share."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"
#: Rows handled at a time in a task.
STRETCH = 1024


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables; `folder` may be any path that Spark can read."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once per context.

    Functions that run in tasks are found by name there, also where only the driver has the
    package on its path.
    """
    context = spark.sparkContext
    if getattr(context, "_glossweave_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="glossweave-")) / "glossweave_llm_source.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))
    context._glossweave_shipped = True


def shared_folder(spark: SparkSession) -> None:
    """Use the folder in spark.checkpoint.dir for what is written between steps.

    Where the setting is missing, a local master gets a temporary folder and a cluster
    the warehouse, which all of its executors reach.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get(CHECKPOINT_SETTING, None)
        if named is None and context.master.split("[")[0] == "local":
            named = tempfile.mkdtemp(prefix="glossweave-checkpoint-")
        elif named is None:
            named = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        context.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and go on from those files."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    shared_folder(spark)
    base = str(spark.sparkContext.getCheckpointDir()).rstrip("/")
    return f"{base}/table-{uuid.uuid4()}"


def written(df: DataFrame) -> DataFrame:
    """Like cut, but as a Parquet table, so that the planner knows its real size.

    A join with it is a broadcast only if that size is below the session's threshold.
    """
    path = written_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _store(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def present(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at `path`, in any store that Spark reads."""
    where, store = _store(spark, path)
    return store.exists(where)


def removed(spark: SparkSession, path: str) -> None:
    """Delete files of a step whose readers are all done."""
    where, store = _store(spark, path)
    store.delete(where, True)


#: What this worker process keeps between tasks: kind -> (key, object).
_KEPT: dict[str, tuple[object, object]] = {}


def kept(kind: str, key: object, make: Callable[[], object]) -> object:
    """The worker's one object of a kind; made anew when `key` is another one."""
    if kind not in _KEPT or _KEPT[kind][0] != key:
        _KEPT.pop(kind, None)
        _KEPT[kind] = (key, make())
    return _KEPT[kind][1]


def drop_kept(*but: str) -> None:
    """Free what a worker process, which outlives its tasks, keeps for other operators."""
    stale = set(_KEPT) - set(but)
    for kind in stale:
        del _KEPT[kind]
    if stale:
        # States of an encoder point at each other; only the collector frees them.
        gc.collect()
        pa.default_memory_pool().release_unused()


def over_batches(
    df: DataFrame,
    work: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: str,
    keeps: tuple[str, ...] = (),
) -> DataFrame:
    """Apply `work` to stretches of the Arrow batches of `df`; one is in memory at a time.

    `keeps` names the kinds of objects that `work` asks of kept().
    """

    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept(*keeps)
        for batch in batches:
            for begin in range(0, batch.num_rows, STRETCH):
                yield work(batch.slice(begin, STRETCH))

    return df.mapInArrow(run, schema)


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the key as text leaves `part` when divided by `parts`; null keys: false."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))


def texts(df: DataFrame, text: str) -> Column:
    """The text column as a string, null read as empty."""
    return F.coalesce(df[text].cast("string"), F.lit(""))


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that clash with none of the columns of `df`."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
