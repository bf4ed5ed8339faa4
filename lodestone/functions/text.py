"""Cleansing and splitting of texts, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters that cleansing lets pass.
ALLOWED = r"[^가-힣a-zA-Z0-9\s!@#\$%\^&\*\(\)_\-\+=\[\]\{\}\|\\:;\"'<>,\.\?/`~\n\rㅇ·]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def cleansed(text: Column | str) -> Column:
    """Only allowed characters, single blanks, at most one empty line, no page-number lines or image placeholders."""
    t = F.regexp_replace(_c(text), ALLOWED, "")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"^\s+|\s+$", "")
    t = F.regexp_replace(t, r"\n?\s*-\s*[0-9]+\s*-\s*\n?", "\n")
    return F.regexp_replace(t, r"!\[image\]\(/image/placeholder\)", "")


def slices_of(text: Column | str, size: int = 4_000) -> Column:
    """Array of the text's pieces of `size` characters; none for an empty or null text."""
    t = F.coalesce(_c(text), F.lit(""))
    n = F.ceil(F.length(t) / size).cast("int")
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.substring(t, i * size + 1, F.lit(size))))


def sentences(text: Column | str) -> Column:
    """Array of sentences: cut after . ! ? (and the wide forms) before white space, and at line breaks; trimmed, no blanks."""
    parts = F.split(F.coalesce(_c(text), F.lit("")), r"(?<=[.!?。！？])\s+|\n+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")
