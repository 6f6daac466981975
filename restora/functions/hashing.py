"""A hash of whole numbers from plain arithmetic, which other engines can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Odd factors of the hash, each under 2^31, so that no product passes 63 bits.
FACTORS = (1640531527, 1013904223, 1540483477, 1597334677)
MASK = (1 << 32) - 1


def mixed(a: Column, b: Column | int = 0, seed: int = 0) -> Column:
    """A number of 32 bits from a and b (whole numbers; b and seed from 0 up to 2^31); null if one of them is."""
    b = F.lit(b) if isinstance(b, int) else b
    low = lambda c: c.bitwiseAND(F.lit(MASK))
    start = F.pmod(a.cast("bigint"), F.lit(1 << 31)) * F.lit(FACTORS[0]).cast("bigint") + b.cast("bigint") * F.lit(FACTORS[1]).cast("bigint") + F.lit(seed)
    h = low(start)
    h = h.bitwiseXOR(F.shiftright(h, 15))
    h = low(h * F.lit(FACTORS[2]).cast("bigint"))
    h = h.bitwiseXOR(F.shiftright(h, 13))
    h = low(h * F.lit(FACTORS[3]).cast("bigint"))
    return h.bitwiseXOR(F.shiftright(h, 16))
