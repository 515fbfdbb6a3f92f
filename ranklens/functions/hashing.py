"""Portable hashing: uniform draws for sampling and slot-prefixed feature ids.

Draws are a function of row identity and a salt, so a retried task or a rerun picks the same rows.
md5 is used because any SQL engine can recompute it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOT_BITS = 48


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hex_to_long(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("bigint")


def hash_uniform(keys, salt: str) -> Column:
    """Uniform draw in [0, 1): leading 32 bits of ``md5(key1|key2|...|salt)`` over 2**32."""
    text = F.concat_ws("|", *[_col(k).cast("string") for k in keys], F.lit(salt))
    return hex_to_long(F.substring(F.md5(text), 1, 8)) / F.lit(float(2**32))


def hash_index(keys, salt: str, size) -> Column:
    """Uniform integer in [0, size)."""
    return F.floor(hash_uniform(keys, salt) * size).cast("bigint")


def slot_fid(slot: int | Column, value: Column) -> Column:
    """Feature id: slot in the high bits, md5-based hash of the value in the low 48 bits."""
    slot = F.lit(slot) if isinstance(slot, int) else slot
    low = hex_to_long(F.substring(F.md5(value.cast("string")), 1, SLOT_BITS // 4))
    return F.shiftleft(slot.cast("bigint"), SLOT_BITS) + low


def fid_slot(fid: Column) -> Column:
    return F.shiftright(fid, SLOT_BITS).cast("int")
