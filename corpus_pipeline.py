"""Five stages from raw documents to tokens; see STAGES. Counted as part of glossweave.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm import langid, mixing, near_copies, pii, queries
from glossweave.llm.common import fresh, written

#: The stages work on shingles of five words at a similarity of 0.8, PII spans and model
#: accuracy, which SQL doesn't express; tests/llm compares each with a plain version.
ORACLE_SQL = None

#: Texts whose language is less certain than this go.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is found; texts that are null or without a letter go."""
    lang, score = fresh(docs, "lang_pred", "score")
    found = langid.classify(docs, queries.language_model(docs), "text", lang, score)
    good = (F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE)
    return found.where(good).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id."""
    return near_copies.drop_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; personal data as [KIND], terms that reveal it generalised or removed."""
    (spans,) = fresh(docs, "spans")
    clean = pii.sanitised(F.coalesce(F.col("text"), F.lit("")), F.col(spans))
    touched = F.size(spans) > 0
    return pii.personal_spans(docs, "text", spans).select(*[
        F.when(touched, clean).otherwise(F.col("text")).alias("text") if c == "text"
        else F.when(touched, F.length(clean)).otherwise(F.col("n_chars")).cast("long").alias(c) if c == "n_chars"
        else F.col(f"`{c}`")
        for c in docs.columns
    ])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them."""
    (words,) = fresh(docs, "words")
    sized = docs.withColumn(words, mixing.word_count(F.col("text")))
    taken = mixing.mix(sized, F.col(words)).where("repeats > 0")
    (copy,) = fresh(taken, "copy")
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("repeats")))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    return queries.tokens(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written before the next one reads it."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
