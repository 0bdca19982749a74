"""Keyed digests as SQL expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, SparkSession, functions as F

_BLOCK = 64


def hmac_sha256(message: Column, key: str) -> Column:
    """Hex HMAC-SHA256 of a UTF-8 message (RFC 2104). The pads come by scalar subqueries, so no plan's text holds the key."""
    if not key:
        raise ValueError("A signing key is required.")
    secret = key.encode("utf-8")
    if len(secret) > _BLOCK:
        secret = hashlib.sha256(secret).digest()
    secret = secret.ljust(_BLOCK, b"\0")
    pads = [(bytearray(b ^ pad for b in secret),) for pad in (0x36, 0x5C)]
    inner, outer = (SparkSession.active().createDataFrame([pad], "pad binary").scalar() for pad in pads)
    digest = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, digest), 256)
