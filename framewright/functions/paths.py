"""Parts of file paths and safe names, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def local(path: Column) -> Column:
    """A path without the scheme of local files."""
    return F.regexp_replace(path, "^file:/+", "/")


def of_uri(uri: Column) -> Column:
    """The path of an encoded address, as file metadata and image rows have it."""
    return local(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))))


def name(path: Column) -> Column:
    """The last part of a path."""
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_extract(name(path), r"^(.+?)(\.[^.]*)?$", 1)


def suffix(path: Column) -> Column:
    """The last suffix with its dot, else an empty text."""
    return F.regexp_extract(name(path), r"^.+?(\.[^.]*)$", 1)


def has_extension(path: Column, extensions: Sequence[str]) -> Column:
    """Whether the suffix, in lower case, is one of extensions."""
    return F.lower(suffix(path)).isin([e.lower() for e in extensions])


def matches_any(path: Column, patterns: Sequence[str]) -> Column:
    """Whether the name holds one of the patterns; an empty list matches nothing."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.contains(name(path), F.lit(p))
    return hit


def safe_name(text: Column, most: int = 30) -> Column:
    """Blanks to underscores, dots off both ends, cut to most characters."""
    return F.substring(F.regexp_replace(F.replace(text, F.lit(" "), F.lit("_")), r"^\.+|\.+$", ""), 1, most)
