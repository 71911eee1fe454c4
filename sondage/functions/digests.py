"""Keyed digests from built-in functions; the key is folded into the plan as two literals, never a column."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def keyed_digest(text: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a text as 64 hex digits; null for null."""
    key = hashlib.sha256(key).digest() if len(key) > _BLOCK else key
    inner, outer = (bytes(b ^ pad for b in key.ljust(_BLOCK, b"\0")) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(text, "utf-8")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def digest(text: Column) -> Column:
    """SHA-256 of a text as 64 hex digits."""
    return F.sha2(text, 256)
