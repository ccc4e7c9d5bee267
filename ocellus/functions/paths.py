"""Names of clips, keyframes and index files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def with_extension(path: Column, extension: str) -> Column:
    """The path with its file's last extension, if any, replaced."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(extension))


def dirname(path: Column) -> Column:
    """What stands before the last ``/``; empty if there is none."""
    return F.regexp_extract(path, r"^(?s)(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def keyframe_clip(path: Column) -> Column:
    """The clip of a keyframe: what stands before the last ``_``, as an mp4."""
    return F.concat(F.regexp_replace(path, r"_[^_]*$", ""), F.lit(".mp4"))


def keyframe_number(path: Column) -> Column:
    """The digits between the last ``_`` and the extension."""
    return F.regexp_extract(path, r"_([0-9]+)\.[^.]*$", 1).cast("long")


def protocol(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)


def wildcard(template: Column, value: Column, mark: str = "%") -> Column:
    """The template with each mark replaced by the value."""
    return F.replace(template, F.lit(mark), value)


def natural_key(s: Column, digits: int = 20) -> Column:
    """A string whose order is the natural one: digit runs compare as numbers (of at most ``digits`` digits)."""
    padded = F.regexp_replace(s, r"(\d+)", "0" * digits + "$1")
    return F.regexp_replace(padded, r"0*(\d{%d})(?!\d)" % digits, "$1")
