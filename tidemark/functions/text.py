"""Text normalisation used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def source_name(col: Column | str) -> Column:
    """Source trimmed of spaces and lower-cased; null stays null."""
    return F.lower(F.trim(F.col(col) if isinstance(col, str) else col))


def symbol_list(json_text: Column | str) -> Column:
    """Symbols of a JSON array: trimmed, upper-cased, without nulls and blanks, distinct, sorted.

    Null, empty or malformed JSON gives an empty list.
    """
    col = F.col(json_text) if isinstance(json_text, str) else json_text
    return clean_symbols(F.from_json(col, "array<string>"))


def clean_symbols(symbols: Column) -> Column:
    """The rules of :func:`symbol_list` for an array of strings."""
    cleaned = F.transform(symbols, lambda s: F.upper(F.regexp_replace(s, r"^\s+|\s+$", "")))
    kept = F.filter(cleaned, lambda s: s.isNotNull() & (s != ""))
    return F.coalesce(F.array_sort(F.array_distinct(kept)), F.array().cast("array<string>"))


def truncate(text: Column, limit: int) -> Column:
    """At most ``limit`` characters; longer text ends in three dots after trimming its end."""
    cut = F.regexp_replace(F.substring(text, 1, limit - 3), r"\s+$", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit("...")))


def content_hash(headline: Column, summary: Column, html: Column) -> Column:
    """SHA-256 of headline, summary and HTML, null as empty, joined by NUL."""
    nul = F.char(F.lit(0))
    parts = [F.coalesce(headline, F.lit("")), nul, F.coalesce(summary, F.lit("")), nul, F.coalesce(html, F.lit(""))]
    return F.sha2(F.concat(*parts), 256)
