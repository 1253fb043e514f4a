"""Signed session tokens as Column expressions: HMAC-SHA256 from the built-in digest, in address-safe base 64."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def pads(key: bytes) -> tuple[bytes, bytes]:
    """The inner and outer pads of a key."""
    own = (hashlib.sha256(key).digest() if len(key) > BLOCK else key).ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in own), bytes(b ^ 0x5C for b in own)


def hmac_sha256(message: Column, key: bytes) -> Column:
    """The signature's 32 bytes."""
    inner, outer = (F.unhex(F.lit(p.hex())) for p in pads(key))
    first = F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))
    return F.unhex(F.sha2(F.concat(outer, first), 256))


def base64url(data: Column) -> Column:
    return F.translate(F.base64(data), "+/=\r\n", "-_")


def sign(payload: Column, key: bytes) -> Column:
    """payload.signature, both in base 64."""
    body = base64url(payload.cast("binary"))
    return F.concat(body, F.lit("."), base64url(hmac_sha256(body, key)))


def payload_of(token: Column) -> Column:
    body = F.translate(F.split_part(token, F.lit("."), F.lit(1)), "-_", "+/")
    return F.unbase64(F.rpad(body, F.ceil(F.length(body) / 4).cast("int") * 4, F.lit("="))).cast("string")


def is_valid(token: Column, key: bytes, now: Column, expiry: str = "$.exp") -> Column:
    """Whether the signature is the key's and the payload's expiry (seconds) lies ahead; false for anything else."""
    body, signature = (F.split_part(token, F.lit("."), F.lit(k)) for k in (1, 2))
    good = (F.size(F.split(token, r"\.")) == 2) & body.rlike("^[A-Za-z0-9_-]+$") & (signature == base64url(hmac_sha256(body, key)))
    return F.coalesce(F.when(good, F.get_json_object(payload_of(token), expiry).cast("long") > now), F.lit(False))
