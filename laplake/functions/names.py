"""Name folding and slugs for identity matching."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def _accented() -> tuple[str, str]:
    """Characters that decompose into an ASCII character and accents, and those ASCII characters."""
    found = [
        (chr(code), plain) for code in range(0x80, sys.maxunicode + 1)
        if ord(plain := unicodedata.normalize("NFD", chr(code))[0]) < 0x80
    ]
    return "".join(c for c, _ in found), "".join(p for _, p in found)


def fold_name(name: Column | str) -> Column:
    """Decompose accents, drop what is not ASCII, lower-case."""
    column = F.col(name) if isinstance(name, str) else name
    return F.lower(F.regexp_replace(F.translate(column, *_accented()), r"[^\x00-\x7F]", ""))


def first_word(name: Column) -> Column:
    return F.element_at(F.split(F.trim(name), r"\s+"), 1)


def last_word(name: Column) -> Column:
    return F.element_at(F.split(F.trim(name), r"\s+"), -1)


def without(name: Column, text: str) -> Column:
    return F.replace(name, F.lit(text), F.lit(""))
