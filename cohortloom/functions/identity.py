"""Keyed study identifiers."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK_BYTES = 64
_ID_LENGTH = 24


def study_id(person_id: Column, salt: str | None) -> Column:
    """First 24 hex digits of HMAC-SHA256(salt, id); NULL without a salt (RFC 2104)."""
    if not salt:
        return F.lit(None).cast("string")
    key = salt.encode("utf-8")
    if len(key) > _BLOCK_BYTES:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK_BYTES, b"\0")
    inner_pad = F.lit(bytearray(byte ^ 0x36 for byte in key))
    outer_pad = F.lit(bytearray(byte ^ 0x5C for byte in key))
    message = F.encode(person_id.cast("string"), "UTF-8")
    inner = F.unhex(F.sha2(F.concat(inner_pad, message), 256))
    return F.substring(F.sha2(F.concat(outer_pad, inner), 256), 1, _ID_LENGTH)
