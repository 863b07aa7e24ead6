"""File-name functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossweave.functions.text import squeeze, strip

_SPLIT = r"(?s)\A(\.*[^.].*)(\.[^.]*)\z"


def stem(filename: Column) -> Column:
    return F.when(
        filename.rlike(_SPLIT), F.regexp_extract(filename, _SPLIT, 1)
    ).otherwise(filename)


def extension(filename: Column) -> Column:
    return F.regexp_extract(filename, _SPLIT, 2)


def base_name(path: Column) -> Column:
    return F.regexp_replace(path, r"(?s)\A.*[/\\]", "")


def clean_filename(filename: Column) -> Column:
    return F.regexp_replace(filename, r'[<>:"/\\|?*]', "_")


def trim_stem(filename: Column) -> Column:
    return F.concat(strip(stem(filename)), extension(filename))


def fix_stem(filename: Column, chars: int = 60) -> Column:
    """Strip the stem, cut it at the first `--`, then at `chars` characters."""
    kept = strip(F.substring_index(strip(stem(filename)), "--", 1))
    kept = F.when(F.length(kept) > chars, strip(F.left(kept, F.lit(chars)))).otherwise(kept)
    return F.concat(kept, extension(filename))


def title_from_filename(filename: Column) -> Column:
    spaced = F.regexp_replace(stem(filename), "[-_]+", " ")
    return squeeze(spaced)


def short_name(filename: Column) -> Column:
    return strip(F.substring_index(strip(stem(filename)), "_", 1))


def link_words(filename: Column) -> Column:
    """A link's file name as compared with titles."""
    return strip(F.regexp_replace(F.lower(filename), r"[_\-.]+", " "))
