"""Hashes that other systems compute as well."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 32-bit FNV hash's start and factor.
FNV_START, FNV_FACTOR = 2_166_136_261, 16_777_619
# End of the fixed values.


def fnv1a_32(text: Column) -> Column:
    """The 32-bit FNV-1a hash of a string's UTF-8 bytes, as an unsigned number (long); null for null."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    step = lambda h, pair: (h.bitwiseXOR(F.conv(pair, 16, 10).cast("long")) * FNV_FACTOR).bitwiseAND(0xFFFFFFFF)
    return F.aggregate(pairs, F.lit(FNV_START).cast("long"), step)


def hash_partition(key: Column, partitions: int) -> Column:
    """The partition of a message key: its hash as a signed number, the remainder without its sign; null for no key."""
    h = fnv1a_32(key)
    return F.abs(F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h) % partitions).cast("int")
