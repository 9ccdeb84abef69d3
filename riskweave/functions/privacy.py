"""Masking, tokens, hashes, encryption and request authentication as native column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three masking patterns, applied in this order, and their replacements.
PII_PATTERNS = [
    (r"\b\d{12,19}\b", "<PAN>"),
    (r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b", "<IBAN>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<IP>"),
]


def mask_pii(text: Column) -> Column:
    for pattern, label in PII_PATTERNS:
        text = F.regexp_replace(text, pattern, label)
    return text


def mask_agent(text: Column, n: int = 120) -> Column:
    return mask_pii(F.substring(text, 1, n))


def ip_cidr24(ip: Column) -> Column:
    """First three octets as a /24; values without a dot pass unchanged."""
    parts = F.slice(F.split(ip, r"\."), 1, 3)
    return F.when(ip.contains("."), F.concat(F.array_join(parts, "."), F.lit(".0/24"))).otherwise(ip)


def valid_device(device: Column) -> Column:
    return F.coalesce(device.rlike("^[A-Za-z0-9]+$"), F.lit(False))


def content_hash(value: Column) -> Column:
    return F.sha2(value, 256)


def sanitize_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9_]", "_")


def hmac_sha256(message: Column, key: bytes) -> Column:
    """Binary HMAC-SHA256 built from two nested ``sha2`` calls, so it stays in the JVM."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in block))
    outer = F.lit(bytearray(b ^ 0x5C for b in block))
    digest = F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))
    return F.unhex(F.sha2(F.concat(outer, digest), 256))


def pii_token(value: Column, key: bytes) -> Column:
    return F.lower(F.hex(hmac_sha256(value, key)))


def base64_text(value: Column) -> Column:
    """Base64 on one line; Spark's own breaks lines after 76 characters."""
    return F.translate(F.base64(value), "\r\n", "")


def encrypt_pii(value: Column, key: bytes) -> Column:
    """AES-256-GCM, base64 of nonce, ciphertext and tag; a fresh nonce per value."""
    return base64_text(F.aes_encrypt(value, F.lit(bytearray(key)), F.lit("GCM")))


def decrypt_pii(value: Column, key: bytes) -> Column:
    return F.aes_decrypt(F.unbase64(value), F.lit(bytearray(key)), F.lit("GCM")).cast("string")


def signing_text(method: Column, path: Column, ts: Column, body: Column, nonce: Column) -> Column:
    return F.concat_ws("|", method, path, ts, F.coalesce(nonce, F.lit("")), F.coalesce(body, F.lit("")))


def sign(method: Column, path: Column, ts: Column, body: Column, nonce: Column, key: bytes) -> Column:
    return base64_text(hmac_sha256(signing_text(method, path, ts, body, nonce), key))


def skew_reason(now: Column, ts: Column, skew: int = 60) -> Column:
    """Reason code for a claimed epoch second given as text; null when it is close enough to ``now``."""
    claimed = ts.try_cast("bigint")
    return (
        F.when(ts.isNull() | (ts == ""), "missing_signature")
        .when(claimed.isNull(), "invalid_timestamp")
        .when(F.abs(now - claimed) > skew, "signature_expired")
    )


def url_unbase64(text: Column) -> Column:
    """Decode unpadded url-safe base64; null when it is not base64."""
    plain = F.translate(text, "-_", "+/")
    padded = F.rpad(plain, F.ceil(F.length(plain) / 4).cast("int") * 4, F.lit("="))
    return F.try_to_binary(padded, F.lit("base64"))


def token_reason(token: Column, now: Column, key: bytes, issuer: str, audience: str) -> Column:
    """First failed check of a signed HS256 claim token, or null when it is good."""
    parts = F.split(token, r"\.")
    signed = F.concat_ws(".", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))
    header = F.from_json(url_unbase64(F.get(parts, F.lit(0))).cast("string"), "alg string")
    claims = F.from_json(
        url_unbase64(F.get(parts, F.lit(1))).cast("string"), "iss string, aud string, iat bigint, exp bigint"
    )
    missing = claims.isNull()
    for name in ("exp", "iat", "iss", "aud"):
        missing = missing | claims[name].isNull()
    good_signature = url_unbase64(F.get(parts, F.lit(2))) == hmac_sha256(signed, key)
    return (
        F.when(token.isNull() | (F.size(parts) != 3), "malformed")
        .when(~F.coalesce(header["alg"] == "HS256", F.lit(False)), "algorithm")
        .when(~F.coalesce(good_signature, F.lit(False)), "signature")
        .when(missing, "missing_claim")
        .when(claims["exp"] <= now, "expired")
        .when(claims["iat"] > now, "not_yet_valid")
        .when(claims["aud"] != audience, "audience")
        .when(claims["iss"] != issuer, "issuer")
    )
