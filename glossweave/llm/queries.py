"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm import ann, bpe, knn_join, langid, licenses, mixing, phrases, pii, pq, quality_crf, secrets, simhash, spelling
from glossweave.llm.common import held_out, table
from glossweave.llm.spans import count_of, listed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def tokens(docs: DataFrame, memory: int = bpe.REMEMBERED) -> DataFrame:
    """Encoded and decoded texts as digests, one row per document."""
    ranks = bpe.read_ranks(public_tokenizers.path(RANKS))
    made = bpe.encode(
        docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN, decoded=True, keep_text=False, memory=memory
    )
    return made.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )


@query
def op1_ann(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    found = ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))
    return found.withColumnRenamed("id", "vec_id")


@query
def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return tokens(table(spark, folder, "documents"), 3 * bpe.REMEMBERED)


@query
def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), simhash.fingerprint_text(F.col("fp")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def as_files(docs: DataFrame) -> DataFrame:
    """Documents under paths source/shelf/box/file, by their ids.

    The table has no paths. Texts that are little more than a licence line stand for the
    licence files of a shelf, as they do in a repository.
    """
    line = F.regexp_extract("text", r"(?m)^.*(?i:licen[cs]e).*$", 0)
    is_licence = (F.length(line) > 0) & (F.length("text") - F.length(line) <= 100)
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    shelf = F.concat(F.lit("shelf"), F.coalesce(F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("")))
    box = F.concat(F.lit("box"), F.coalesce(F.floor(F.col("doc_id") / 100).cast("string"), F.lit("")))
    name = F.when(is_licence, F.concat(F.lit("LICENSE."), number)).otherwise(
        F.concat(box, F.lit("/"), number, F.lit(".txt"))
    )
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), shelf, name)
    return docs.select("doc_id", "text", path.alias("path"))


@query
def op4_licenses(spark: SparkSession, folder: str) -> DataFrame:
    files = as_files(table(spark, folder, "documents"))
    found = licenses.licences(files).withColumn("doc_id", F.regexp_extract("path", r"([0-9]+)(?:\.txt)?$", 1).cast("long"))
    return found.select("doc_id", "path", "licence", "cosine", "inherited_from")


@query
def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.personal_spans(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.KINDS))
    return found.select(
        "doc_id", *[count_of(F.col("spans"), k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


@query
def op6_pq(spark: SparkSession, folder: str) -> DataFrame:
    found = pq.near_duplicates(table(spark, folder, "embeddings"))
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(True))
    return found.select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), kept.alias("kept")
    )


@query
def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.KINDS))
    return found.select(
        "doc_id", *[count_of(F.col("spans"), k).alias(f"n_{k}") for k in secrets.KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


def language_model(docs: DataFrame) -> langid.Model:
    """Learned from the rows that are not held out."""
    pieces = langid.read_pieces(public_tokenizers.path(PIECES))
    return langid.fit(docs.where(~held_out(F.col("doc_id"), 3, 1)), pieces)


@query
def op8_langid(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = langid.classify(docs.select("doc_id", "text"), language_model(docs))
    return found.select(
        "doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score"
    )


@query
def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"))
    return mixing.mix(sized, F.col("words")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken")
    )


ORACLES["op9_mixing"] = r"""
WITH docs AS (
  SELECT doc_id, source, md5('mix:' || doc_id) AS k,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source
), weighed AS (
  SELECT *, source_size * 3 AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sources
), levels AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shares
  FROM weighed WINDOW o AS (ORDER BY cap::DOUBLE / w, source NULLS LAST)
), first_open AS (
  SELECT rest, shares FROM levels WHERE rest * w <= cap * shares ORDER BY cap::DOUBLE / w, source NULLS LAST LIMIT 1
), plan AS (
  SELECT l.source, l.source_size,
    least(coalesce(f.rest::DOUBLE * l.w::DOUBLE / f.shares::DOUBLE, l.cap::DOUBLE), l.cap::DOUBLE) AS target
  FROM levels l LEFT JOIN first_open f ON true
), placed AS (
  SELECT d.doc_id, d.size, p.source_size, p.target,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    CASE WHEN p.source_size > 0 THEN floor(p.target / p.source_size) ELSE 0 END AS whole
  FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN before + size / 2.0 < target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""


@query
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = quality_crf.fit(docs, labels.where(~held_out(F.col("doc_id"), 5, 0)))
    found = quality_crf.score(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


@query
def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(phrases.frequent_phrases(table(spark, folder, "documents")))


ORACLES["op11_phrases"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang
), grams AS (
  SELECT lang, k, w[i:i + k - 1] AS g
  FROM worded, (VALUES (1), (2), (3), (4), (5)) AS lengths(k), unnest(range(1, len(w) - k + 2)) AS places(i)
), counts AS (
  SELECT lang, g, k, count(*) AS c FROM grams GROUP BY lang, g, k HAVING count(*) >= 100
), cuts AS (
  SELECT p.lang, p.g, p.k, p.c AS a, j, l.c AS l, r.c AS r, t.n,
    (1000::HUGEINT * p.c * t.n) // (l.c::HUGEINT * r.c) AS score
  FROM counts p, unnest(range(1, p.k)) AS places(j), counts l, counts r, totals t
  WHERE l.lang = p.lang AND l.g = p.g[1:j] AND r.lang = p.lang AND r.g = p.g[j + 1:] AND t.lang = p.lang
), least AS (
  SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, j) AS place FROM cuts
), open_ones AS (
  SELECT s.* FROM least s
  WHERE place = 1 AND NOT EXISTS (
    SELECT 1 FROM counts b
    WHERE b.lang = s.lang AND b.k = s.k + 1 AND 100 * b.c >= 100 * s.a AND (b.g[1:s.k] = s.g OR b.g[2:] = s.g))
), ranked AS (
  SELECT *, array_to_string(g, ' ') AS phrase FROM open_ones
), numbered AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
    phrase, a, l, r, n, score::BIGINT AS score
  FROM ranked
)
SELECT lang, rank, phrase, a, l, r, n, score FROM numbered WHERE rank <= 2000
"""


@query
def op12_knn_join(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    found = knn_join.top_products(vectors, vectors.where("vec_id % 100 = 0"))
    return found.withColumnRenamed("id", "vec_id")


ORACLES["op12_knn_join"] = """
WITH good AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
  FROM good q JOIN good d ON q.vec_id <> d.vec_id
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query
def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents").select("doc_id", "text"))
