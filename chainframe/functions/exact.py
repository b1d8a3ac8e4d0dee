"""Exact integer arithmetic on Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U64, I128 = "decimal(20,0)", "decimal(38,0)"


def floordiv(a: Column, b: Column) -> Column:
    """Python's floor division of wide integers; exact, where ``/`` would round first."""
    a, b = a.cast(I128), b.cast(I128)
    return ((a - F.pmod(a, b)) / b).cast(I128)


def ceildiv(a: Column, b: Column) -> Column:
    return floordiv(a.cast(I128) + b.cast(I128) - 1, b)


def boundary(block: Column, transaction: Column) -> Column:
    """One ordinal for a place in the chain; transaction -1 is the block's own boundary."""
    return F.shiftleft(block.cast("long"), 32) + transaction + 1


def boundary_block(b: Column) -> Column:
    return F.shiftright(b, 32)


def boundary_transaction(b: Column) -> Column:
    return b.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")) - 1


def int128_bytes(value: Column) -> Column:
    """Signed big-endian 16 bytes of a wide integer, by two unsigned halves."""
    half = F.lit(str(1 << 64)).cast(I128)
    low = F.pmod(value.cast(I128), half)
    high = ((value.cast(I128) - low) / half).cast(I128)

    def word(x: Column) -> Column:
        top = F.lit(1 << 32).cast(I128)
        lo = F.pmod(x, top)
        hi = F.pmod(((x - lo) / top).cast(I128), top)
        pad = lambda y: F.lpad(F.hex(y.cast("long")), 8, "0")
        return F.concat(pad(hi), pad(lo))

    return F.unhex(F.concat(word(high), word(low)))


def int128_value(data: Column) -> Column:
    """The wide integer in 16 signed big-endian bytes (below 10**38)."""
    part = lambda i: F.conv(F.hex(F.substring(data, 1 + 4 * i, 4)), 16, 10).cast(I128)
    signed = F.when(part(0) >= (1 << 31), part(0) - (1 << 32)).otherwise(part(0))
    total = signed
    for i in (1, 2, 3):
        total = (total * F.lit(1 << 32).cast("decimal(10,0)")).cast(I128) + part(i)
    return total.cast(I128)
