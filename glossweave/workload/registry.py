"""Named queries with, where SQL can say it, the statement that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossweave.session import tune
from glossweave.workload.views import Views, with_views

Build = Callable[[Views], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _plain(df: DataFrame) -> DataFrame:
    """Whole numbers as long, so that both engines name the same types."""
    small = (T.IntegerType, T.ShortType, T.ByteType)
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("long").alias(f.name)
            if isinstance(f.dataType, small)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query over the views; `sql` may use the same views by name."""

    def add(build: Build) -> Build:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return _plain(build(Views(tune(spark), folder)))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return build

    return add
