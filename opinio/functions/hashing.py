"""Hash-derived identifiers and content fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def comment_external_id(url: Column, user: Column, body: Column) -> Column:
    """First 8 bytes of md5(url + user + body) read as a big-endian
    signed 64-bit integer (``conv`` with a negative base keeps the sign)."""
    key = F.concat(url, user, body)
    return external_id_of(key)


def external_id_of(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 16), 16, -10).cast("bigint")


def content_hash(*cols: Column) -> Column:
    """Fingerprint for version comparison (W6); NULL-safe via a separator
    that cannot collide with absent fields."""
    return F.xxhash64(*[F.coalesce(c, F.lit("\u0000null")) for c in cols])
