"""String similarity: equality and containment as columns, the rest in Arrow batches."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from glossweave.functions.text import strip

CONTAINED = 0.8


@pandas_udf(DoubleType())
def matching_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; rows that need no ratio come as null."""
    out = []
    for a, b in zip(left, right):
        out.append(None if a is None or b is None else SequenceMatcher(None, a, b).ratio())
    return pd.Series(out, dtype="float64")


def similarity(left: Column, right: Column) -> Column:
    """1.0 when equal, 0.8 when one holds the other, else the matching ratio."""
    a, b = strip(F.lower(left)), strip(F.lower(right))
    simple = F.when(a == b, F.lit(1.0)).when(
        F.contains(a, b) | F.contains(b, a), F.lit(CONTAINED)
    )
    ratio = matching_ratio(F.when(simple.isNull(), a), F.when(simple.isNull(), b))
    return F.coalesce(simple, ratio)
