"""Row-local hashes whose value depends on nothing but the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 10_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def salted_md5(key: Column | str, seed: int, salt: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:{salt}:"), _col(key).cast("string")))


def hash_bucket(key: Column | str, seed: int, salt: str) -> Column:
    """Bucket 0..9999 from the first 32 bits of a salted md5."""
    head = F.conv(F.substring(salted_md5(key, seed, salt), 1, 8), 16, 10)
    return (head.cast("long") % BUCKETS).cast("int")
