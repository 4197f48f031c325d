"""Keyed and plain hash expressions: splits, variants and pseudonyms."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_prefix(text: Column) -> Column:
    """The first eight bytes of SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def unit_interval(text: Column) -> Column:
    """A hash of the text in [0, 1)."""
    return hash_prefix(text).cast("double") / F.lit(2.0**64)


def variant(text: Column, percent: float) -> Column:
    """candidate for about `percent` of all texts, else control."""
    return F.when(hash_prefix(text) % 10000 < int(percent * 100), "candidate").otherwise("control")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Keyed digest (HMAC, SHA-256) of a text, as lower-case hex; made of two plain digests."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    inner, outer = (F.lit(bytearray(b ^ pad for b in key.ljust(64, b"\0"))) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)
