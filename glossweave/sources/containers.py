"""E-book containers (zip files) read through Spark's binary file source."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave import schemas
from glossweave.functions.names import base_name
from glossweave.functions.text import strip
from glossweave.sources.pages import item_id

DOCUMENT_ENDINGS = (".html", ".xhtml", ".htm")
IMAGE_ENDINGS = (".jpg", ".jpeg", ".png", ".gif", ".bmp")

_MEMBERS = """path string, ordinal int, member string, size long, body string"""


def read_containers(spark: SparkSession, folder: str) -> DataFrame:
    """All `*.epub` files under a folder. Listing alone does not read the bytes: columns
    that are not selected are not loaded."""
    return (
        spark.read.format("binaryFile")
        .schema(schemas.CONTAINERS)
        .option("pathGlobFilter", "*.[eE][pP][uU][bB]")
        .option("recursiveFileLookup", "true")
        .load(folder)
    )


def file_hash(containers: DataFrame) -> DataFrame:
    return containers.select("path", "length", F.md5("content").alias("md5"))


def _open(content: bytes) -> zipfile.ZipFile | None:
    try:
        return zipfile.ZipFile(io.BytesIO(content))
    except Exception:
        return None


def _read_members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per member; text bodies only for documents, OPF and NCX files."""
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"]):
            archive = _open(content)
            if archive is None:
                yield pd.DataFrame(
                    {"path": [path], "ordinal": [-1], "member": [None], "size": [0], "body": [None]}
                )
                continue
            with archive:
                # One frame per member keeps a large container from piling up.
                for n, info in enumerate(archive.infolist()):
                    body = None
                    if info.filename.lower().endswith((*DOCUMENT_ENDINGS, ".opf", ".ncx")):
                        try:
                            body = archive.read(info).decode("utf-8", errors="ignore")
                        except Exception:
                            body = None
                    yield pd.DataFrame(
                        {"path": [path], "ordinal": [n], "member": [info.filename],
                         "size": [info.file_size], "body": [body]}
                    )


def members(containers: DataFrame) -> DataFrame:
    """`(path, ordinal, member, size, body)`; an unreadable file gives one row with
    ordinal -1."""
    return containers.select("path", "content").mapInPandas(_read_members, _MEMBERS)


def is_document(member):
    found = F.lit(False)
    for ending in DOCUMENT_ENDINGS:
        found = found | member.endswith(ending)
    return found


def valid_containers(containers: DataFrame, listed: DataFrame) -> DataFrame:
    """Containers with their validity: right extension, readable, holds a document."""
    with_document = listed.where(is_document(F.col("member"))).select("path").distinct()
    return (
        containers.select("path", "length", "modificationTime")
        .join(with_document.withColumn("has_document", F.lit(True)), "path", "left")
        .select(
            "path",
            "length",
            "modificationTime",
            (
                F.lower("path").endswith(".epub") & F.coalesce("has_document", F.lit(False))
            ).alias("is_valid"),
        )
    )


def container_items(listed: DataFrame) -> DataFrame:
    """Documents of containers, in the shape `sources.pages.with_elements` takes."""
    return listed.where(is_document(F.col("member")) & F.col("body").isNotNull()).select(
        F.col("path").alias("book_id"),
        "ordinal",
        "member",
        item_id(F.col("member")).alias("item_id"),
        F.col("body").alias("html"),
    )


def metadata(listed: DataFrame) -> DataFrame:
    """First title, creator and language of each container's package file.

    Files are read by tag name whatever their prefix; language is lower-cased and falls
    back to `en`.
    """

    def first_tag(tag: str):
        pattern = rf"(?s)<(?:[\w.-]+:)?{tag}(?:\s[^>]*)?>(.*?)</"
        value = strip(F.regexp_extract("body", pattern, 1))
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"),
                             ("&amp;", "&")):
            value = F.replace(value, F.lit(entity), F.lit(char))
        return F.when(F.length(value) > 0, value)

    first_opf = (
        listed.where(F.lower("member").endswith(".opf") & F.col("body").isNotNull())
        .groupBy("path")
        .agg(F.min_by("body", "ordinal").alias("body"))
    )
    return first_opf.select(
        "path",
        base_name(F.col("path")).alias("filename"),
        first_tag("title").alias("title"),
        first_tag("creator").alias("author"),
        F.lower(F.coalesce(first_tag("language"), F.lit("en"))).alias("language"),
    )


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Valid containers with their metadata: `(path, filename, title, author, language,
    file_size)`. A valid file without readable metadata keeps its row."""
    from glossweave.functions.names import title_from_filename, trim_stem

    files = read_containers(spark, folder)
    listed = members(files)
    valid = valid_containers(files, listed).where("is_valid")
    named = valid.select(
        "path",
        trim_stem(base_name(F.col("path"))).alias("filename"),
        F.col("length").alias("file_size"),
    )
    return named.join(metadata(listed).drop("filename"), "path", "left").select(
        "path",
        "filename",
        F.coalesce("title", title_from_filename(F.col("filename"))).alias("title"),
        "author",
        F.coalesce("language", F.lit("en")).alias("language"),
        "file_size",
    )


def cover_candidates(listed: DataFrame) -> DataFrame:
    """Image members with what the package file says about them, for `operators.covers`."""
    opf = (
        listed.where(F.lower("member").endswith(".opf") & F.col("body").isNotNull())
        .groupBy("path")
        .agg(
            F.min_by("member", "ordinal").alias("opf_member"),
            F.min_by("body", "ordinal").alias("opf"),
        )
    )
    meta = F.regexp_extract(
        "opf", r'(?is)<(?:\w+:)?meta\b(?=[^>]*\bname="cover")[^>]*\bcontent="([^"]*)"', 1
    )
    items = F.regexp_extract_all("opf", F.lit(r"(?is)<(?:\w+:)?item\b[^>]*>"), 0)

    def attribute(item, name):
        return F.regexp_extract(item, rf'(?is)\b{name}="([^"]*)"', 1)

    folder = F.regexp_extract("opf_member", r"\A(.*/)[^/]*\z", 1)
    manifest = opf.select(
        "path",
        meta.alias("meta_cover"),
        F.posexplode(items).alias("nth", "item"),
        folder.alias("folder"),
    ).select(
        "path",
        "nth",
        F.concat("folder", attribute(F.col("item"), "href")).alias("member"),
        attribute(F.col("item"), "id").alias("manifest_id"),
        F.lower(attribute(F.col("item"), "properties")).alias("props"),
    )
    declared = manifest.groupBy("path", "member").agg(
        F.min_by("manifest_id", "nth").alias("manifest_id"),
        F.min_by("props", "nth").alias("props"),
        F.min("nth").alias("nth"),
    )
    return (
        listed.where(F.col("member").isNotNull())
        .select("path", "member", "size")
        .join(declared, ["path", "member"], "left")
        .join(opf.select("path", F.when(meta != "", meta).alias("meta_cover")), "path", "left")
        .withColumnRenamed("path", "book_id")
    )
