"""Content-derived ids, digests, keyed fingerprints and encryption."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stable_id(namespace: str, text: Column) -> Column:
    return F.concat(F.lit(f"{namespace}_"), F.substring(F.sha2(text, 256), 1, 24))


def joined_digest(*parts: Column) -> Column:
    """SHA-256 of the parts joined by NUL."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def hmac_sha256(message: Column, key: bytes) -> Column:
    """Keyed digest (hex) by composition; the padded key is a literal, so keep such plans out of logs."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.unhex(F.sha2(F.concat(F.lit(bytearray(b ^ 0x36 for b in key)), message.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(bytearray(b ^ 0x5C for b in key)), inner), 256)


def encrypt(plain: Column, key: Column, nonce: Column, aad: Column) -> Column:
    """struct(ciphertext, nonce, auth_tag) by AES-256-GCM."""
    whole = F.aes_encrypt(plain.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), nonce, aad)
    n = F.octet_length(whole)
    return F.struct(F.substring(whole, F.lit(13), n - 28).alias("ciphertext"), F.substring(whole, F.lit(1), F.lit(12)).alias("nonce"), F.substring(whole, n - 15, F.lit(16)).alias("auth_tag"))


def decrypt(row: Column, key: Column, aad: Column) -> Column:
    """The plain text, or null if anything was tampered with."""
    return F.try_aes_decrypt(F.concat(row["nonce"], row["ciphertext"], row["auth_tag"]), key, F.lit("GCM"), F.lit("DEFAULT"), aad).cast("string")


def table_digest(df: DataFrame, columns: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """``n`` and ``digest`` of a table, or of each group ``by``, regardless of row order: rows are hashed where they lie and only sums travel."""
    row = F.sha2(F.to_json(F.struct(*(columns or sorted(df.columns))), {"ignoreNullFields": "false"}), 256)
    parts = [F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = [F.coalesce(F.sum(p), F.lit(0)).cast("string") for p in parts]
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws(":", *sums), 256).alias("digest"))
