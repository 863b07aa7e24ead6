import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts, or from (doc_id, text, lang, source)."""

    def make(rows):
        full = [r if isinstance(r, tuple) else (n, r, "en", "a") for n, r in enumerate(rows)]
        return spark.createDataFrame([(*r, len(r[1] or "")) for r in full], DOCS)

    return make


@pytest.fixture
def folder_of(tmp_path):
    """A folder in which tables are written under their names."""

    def save(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return save
