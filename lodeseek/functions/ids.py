"""Identities as column expressions: content hashes, version 5 UUIDs, 64-bit point ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the DNS namespace of RFC 4122.
NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def content_hash(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the text."""
    return F.substring(F.sha2(text, 256), 1, 16)


def uuid5(key: Column) -> Column:
    """Version 5 UUID of a key in NAMESPACE."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), F.encode(key, "UTF-8")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def chunk_id(path: Column, start: Column, end: Column) -> Column:
    """Identity of a line range of a file."""
    return uuid5(F.concat_ws(":", path, start.cast("string"), end.cast("string")))


def point_id(chunk: Column) -> Column:
    """Unsigned 64-bit number of the first 8 bytes of the MD5, as decimal(20,0)."""
    return F.conv(F.substring(F.md5(chunk), 1, 16), 16, 10).cast("decimal(20,0)")
