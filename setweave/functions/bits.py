"""Hash functions of the table layouts on 32-bit keys, in 64-bit arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW = 0xFFFFFFFF


def _times(x: Column, factor: int) -> Column:
    """x * factor in 32 bits, without ever leaving 63."""
    high = (x * F.lit(factor >> 16)).bitwiseAND(F.lit(0xFFFF))
    return (x * F.lit(factor & 0xFFFF) + F.shiftleft(high, 16)).bitwiseAND(F.lit(_LOW))


def mix32(key: Column) -> Column:
    """The 32-bit finaliser of murmur3, unsigned in a long."""
    h = key.cast("long").bitwiseAND(F.lit(_LOW))
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = _times(h.bitwiseXOR(F.shiftright(h, shift)), factor)
    return h.bitwiseXOR(F.shiftright(h, 16))


def set_hash(key: Column, owner: Column, capacity: Column) -> Column:
    """First hash of a key in its owner's table; capacity is a power of two."""
    return key.bitwiseXOR(F.shiftright(key, 8)).bitwiseXOR(owner).bitwiseAND(capacity - 1)


def second_hash(key: Column, owner: Column, capacity: Column) -> Column:
    x = key.bitwiseXOR(F.shiftright(key, 16)).bitwiseXOR(F.shiftleft(owner, 1)).bitwiseXOR(F.lit(0xAAAAAAAA))
    return x.bitwiseAND(capacity - 1)


def interleaved(value: Column, buckets: Column, lanes: int = 32) -> Column:
    """Bucket of a hash value with neighbouring values spread over `lanes` ranges; buckets is a multiple of lanes."""
    return F.pmod(value, F.lit(lanes)) * F.floor(buckets / lanes) + F.floor(value / lanes)
