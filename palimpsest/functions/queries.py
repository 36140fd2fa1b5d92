"""What a natural-language query mentions: file paths and code identifiers, as columns. All native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_camel_case, is_dot_notation, is_path_like, is_snake_case, looks_like_path

_TICKS = "`([^`]*)`"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\r?\n")


def _words(line: Column, signs: str) -> Column:
    """White-space tokens of a line without the signs around them."""
    bare = F.transform(F.split(line, r"\s+"), lambda t: F.regexp_replace(t, f"^[{signs}]+|[{signs}]+$", ""))
    return F.filter(bare, lambda t: t != "")


def normalized_path(path: Column) -> Column:
    """Forward slashes, none at the start."""
    return F.regexp_replace(F.translate(path, "\\", "/"), "^/+", "")


def file_paths(text: Column) -> Column:
    """Paths in a query, first seen first: those of tracebacks, in backticks, and bare, with a line number cut off."""

    def of(line: Column) -> Column:
        trace = F.array(F.trim(F.regexp_extract(line, 'File "([^"]*)"', 1)))
        ticks = F.regexp_extract_all(line, F.lit(_TICKS), F.lit(1))
        bare = F.transform(_words(line, r""",;)('"`"""), lambda t: F.regexp_replace(t, r":\d+$", ""))
        return F.filter(F.concat(trace, ticks, bare), looks_like_path)

    found = F.transform(F.flatten(F.transform(_lines(text), of)), normalized_path)
    return F.array_distinct(F.filter(found, lambda p: p != ""))


def code_identifiers(text: Column) -> Column:
    """Identifiers in a query, first seen first: anything of two bytes in backticks, and words that look like code."""

    def of(line: Column) -> Column:
        ticks = F.filter(F.transform(F.regexp_extract_all(line, F.lit(_TICKS), F.lit(1)), lambda x: F.trim(x)), lambda t: F.octet_length(t) >= 2)
        words = F.filter(_words(line, r""",;)('"`:.!?"""), lambda t: (F.octet_length(t) >= 3) & (is_snake_case(t) | is_camel_case(t) | is_dot_notation(t) | is_path_like(t)))
        return F.concat(ticks, words)

    return F.array_distinct(F.flatten(F.transform(_lines(text), of)))
