"""Stable hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_fraction(value: Column, salt: str = "") -> Column:
    """A reproducible number in [0, 1] from the first eight bytes of a SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), value), 256)
    integer = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double")
    return integer / F.lit(float((1 << 64) - 1))


def short_id(*parts: Column) -> Column:
    """First sixteen hex digits of the SHA-256 over bar-joined parts."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)
