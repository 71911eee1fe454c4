"""Identifiers that are written in several ways, and time zones kept out of day arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_blank(c: Column) -> Column:
    """True for null and for text of white space only."""
    return F.coalesce(F.length(F.regexp_replace(c, r"\s+", "")) == 0, F.lit(True))


def hex_key(c: Column, digits: int) -> Column:
    """The ``digits`` hex digits that ``c`` spells, in lower case.

    Case, white space, dashes, braces and a leading scheme (``urn:uuid:``, ``hmac-sha256:``) make no
    difference. Text that does not end in that many hex digits keeps its letters and digits, so it
    equals only other spellings of itself. Null and blank give null.
    """
    plain = F.regexp_replace(F.lower(c), "[^0-9a-z]", "")
    digest = F.regexp_extract(plain, f"([0-9a-f]{{{digits}}})$", 1)
    # Most are written plainly already: one look instead of three rewritings.
    return F.when(F.rlike(c, F.lit(f"^[0-9a-f]{{{digits}}}\\z")), c).when(is_blank(c), F.lit(None)).when(digest != "", digest).otherwise(F.concat(F.lit("?"), plain))


def clean_name(c: Column) -> Column:
    """Lower case without white space around it; null where nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), F.lit(""))


def utc_day(ts: Column) -> Column:
    """The UTC date of a timestamp, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(F.unix_micros(ts) / F.lit(86_400_000_000)).cast("int"))
