"""Explicit schemas of the tables the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

BOOKS = """book_id string, filename string, title string, author string, isbn string,
language string, page_count int, file_size long, status string, summary_text string,
error_message string, created_at timestamp, updated_at timestamp"""

BOOK_OUTPUTS = """book_id string, bilingual_epub string, bilingual_pdf string,
target_epub string, target_pdf string, source_epub string, source_pdf string,
cover_image string, toc_preview_image string, other_images array<string>,
main_image_count int, quality_report string, listing_title string,
listing_description string, listing_tags string, listing_note string,
pan_link_sku1 string, pan_link_sku2 string, pan_code string,
product_id string, product_url string, publish_status string, publish_error string,
created_at timestamp, updated_at timestamp"""

PROCESSING_LOGS = """id long, book_id string, stage string, status string,
message string, created_at timestamp"""

SHARE_LINKS = """filename string, share_url string, extract_code string, note string"""

TOKEN_USAGE = """id long, book_id string, step string, model string, input_tokens long,
output_tokens long, total_tokens long, cost double, created_at timestamp"""

TRANSLATION_MEMORY = """source_hash string, source_text string, translated_text string,
model string, created_at timestamp, updated_at timestamp"""

PARAGRAPHS = """id string, trans_id string, item_id string, idx long, doc_pos int,
text string, tag string, tier string, is_duplicate boolean, original_id string"""

CONTAINERS = "path string, modificationTime timestamp, length long, content binary"

# One parsed element of a page; `text` of a block that holds other blocks is null and
# its own loose text comes in `bare`; `title` is the untouched text of h1-h3 and title.
ELEMENTS = T.ArrayType(
    T.StructType(
        [
            T.StructField("tag", T.StringType()),
            T.StructField("classes", T.ArrayType(T.StringType())),
            T.StructField("elem_id", T.StringType()),
            T.StructField("doc_pos", T.IntegerType()),
            T.StructField("has_block", T.BooleanType()),
            T.StructField("text", T.StringType()),
            T.StructField("bare", T.ArrayType(T.StringType())),
            T.StructField("title", T.StringType()),
        ]
    )
)

QUALITY_DIMENSIONS = """book_id string, dimension string, score double,
issues array<string>, details map<string,double>"""

TIER_SHORT = "tier1_short_repeatable"
TIER_NORMAL = "tier2_normal"
TIER_LONG = "tier3_long_complex"
