"""String helpers shared by the operators. Lengths and offsets count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\x0b\x0c                 　﻿"

SEARCH_SCAN_BYTES = 16 * 1024
TRUNCATION_MARKER = "...[truncated]"


def strip(text: Column) -> Column:
    """Trim every kind of blank, line ends included."""
    return F.btrim(text, F.lit(WHITESPACE))


def optional(text: Column) -> Column:
    """Trimmed text, or null where nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def truncate(text: Column, length: int) -> Column:
    return F.when(F.length(text) <= length, text).otherwise(F.concat(F.substring(text, 1, length - 1), F.lit("...")))


def collapse_blanks(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"[\s\x{00a0}\x{feff}]+", " "))


def tidy_lines(text: Column) -> Column:
    """No blanks before a line end, at most one empty line in a row, trimmed."""
    return strip(F.regexp_replace(F.regexp_replace(text, "[ \t]+\n", "\n"), "\n{3,}", "\n\n"))


def bound_text(text: Column, limit: int = SEARCH_SCAN_BYTES) -> Column:
    """Cut text above ``limit`` UTF-8 bytes on a character boundary and mark the cut."""
    cut = limit - len(TRUNCATION_MARKER)
    head = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, cut).cast("string"))
    whole = F.when(F.octet_length(head) == cut, head).otherwise(F.regexp_replace(head, "�$", ""))
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(whole, F.lit(TRUNCATION_MARKER)))


def session_title(text: Column) -> Column:
    """Prompt text without command envelopes, blanks collapsed, at most 72 characters."""
    plain = F.regexp_replace(text, r"(?is)<local-command-caveat>.*?</local-command-caveat>", " ")
    plain = F.regexp_replace(plain, r"(?is)<command-(?:name|message|args)>.*?</command-(?:name|message|args)>", " ")
    return truncate(F.nullif(collapse_blanks(plain), F.lit("")), 72)
