"""Path and text functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./\\]*)$", 1)


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./\\]*$", "")


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*[/\\])", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def find_first(text: Column, part: str) -> Column:
    """Zero-based place of a part, or -1."""
    return F.instr(text, part) - 1


def find_last(text: Column, part: str) -> Column:
    at = F.instr(F.reverse(text), part[::-1])
    return F.when(at == 0, -1).otherwise(F.length(text) - at - len(part) + 1)


def fields(line: Column) -> Column:
    """Comma-separated fields without blanks around them."""
    return F.transform(F.split(line, ","), lambda x: F.trim(x))


def unsigned(text: Column, most: int) -> Column:
    """A decimal number of 0..most, else null."""
    v = F.when(text.rlike(r"^\d{1,18}$"), text).try_cast("long")
    return F.when(v <= most, v)


def is_hdr_name(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(exr|hdr)$")
