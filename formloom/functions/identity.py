"""Deterministic identities, keyed pseudonyms and content digests as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from formloom.functions.text import strip

# Namespace of the name-based identifiers issued by this package.
NAMESPACE_HEX = "5f0c6a8e2d1b4c7e9a34b1d20c7e55aa"
FACT_ID_SPACE = 2_000_000_000
MINIMUM_KEY_BYTES = 32
_HMAC_BLOCK = 64


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def deterministic_uuid(kind: str, *parts: Column | str) -> Column:
    """UUIDv5 over the kind and the parts, joined by the unit separator; null if a part is null."""
    pieces: list[Column] = [F.lit(kind)]
    for part in parts:
        pieces += [F.lit("\x1f"), _col(part).cast("string")]
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_HEX)), F.encode(F.concat(*pieces), "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8),
        F.lit("-"),
        F.substring(digest, 9, 4),
        F.lit("-5"),
        F.substring(digest, 14, 3),
        F.lit("-"),
        variant,
        F.substring(digest, 18, 3),
        F.lit("-"),
        F.substring(digest, 21, 12),
    )


def integer_fact_id(identifier: Column | str) -> Column:
    """Positive integer key taken from the first four bytes of a UUID."""
    head = F.conv(F.substring(_col(identifier), 1, 8), 16, 10).cast("bigint")
    return head % F.lit(FACT_ID_SPACE) + F.lit(1)


def hmac_pads(key: bytes) -> tuple[str, str]:
    """Inner and outer HMAC-SHA256 pads of one key, as hex for a key table or a literal."""
    if len(key) < MINIMUM_KEY_BYTES:
        raise ValueError(f"pseudonymization keys need at least {MINIMUM_KEY_BYTES} bytes")
    if len(key) > _HMAC_BLOCK:
        key = hashlib.sha256(key).digest()
    block = key.ljust(_HMAC_BLOCK, b"\0")
    inner = bytes(byte ^ 0x36 for byte in block).hex()
    outer = bytes(byte ^ 0x5C for byte in block).hex()
    return inner, outer


def pseudonymize(
    identifier: Column | str,
    namespace: Column | str,
    inner_pad: Column | str,
    outer_pad: Column | str,
) -> Column:
    """``p_`` + 32 hex digits of the keyed hash; null for an empty identifier.

    The pads are columns so that each site can bring its own key through a key table.
    """
    trimmed = strip(_col(identifier).cast("string"))
    message = F.concat(
        F.encode(_col(namespace), "UTF-8"), F.unhex(F.lit("00")), F.encode(trimmed, "UTF-8")
    )
    inner = F.sha2(F.concat(F.unhex(_col(inner_pad)), message), 256)
    outer = F.sha2(F.concat(F.unhex(_col(outer_pad)), F.unhex(inner)), 256)
    return F.when(trimmed != "", F.concat(F.lit("p_"), F.substring(outer, 1, 32)))


def canonical_json(**fields: Column | str) -> Column:
    """Compact JSON object with its keys in sorted order and nulls kept."""
    ordered = [_col(fields[name]).alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def content_hash(**fields: Column | str) -> Column:
    """SHA-256 of the canonical JSON of the fields."""
    return F.sha2(canonical_json(**fields), 256)


def release_key(prefix: str, digest: Column | str) -> Column:
    """Short content id: prefix, underscore and the first sixteen hex digits."""
    return F.concat(F.lit(prefix + "_"), F.substring(_col(digest), 1, 16))


_LANES = ((1, 15), (16, 15), (31, 15), (46, 15))


def multiset_digest(row_hash: Column | str) -> Column:
    """Aggregate: order-free digest of a bag of SHA-256 hex strings.

    Each hash is split into four 60-bit lanes that are summed, so the aggregate combines on the
    map side and keeps a constant-size buffer whatever the group holds; the sums have room for
    10^19 rows. Repeated rows count.
    """
    hashed = _col(row_hash)
    sums = [
        F.coalesce(
            F.sum(F.conv(F.substring(hashed, start, width), 16, 10).cast("decimal(28,0)")),
            F.lit(0).cast("decimal(38,0)"),
        ).cast("string")
        for start, width in _LANES
    ]
    return F.sha2(F.concat_ws(":", *sums, F.count(hashed).cast("string")), 256)
