"""A count-min prefilter: which hashed items may occur twice or more."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written

ROWS = 2
CELL_BITS = 31
#: The bitmap that executors receive has at most 2**MOST_BITS bits a row (256 MB for both rows).
MOST_BITS = 30
LEAST_BITS = 18
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
CELLS_SCHEMA = "cell long, n long"


def cells(hashes: np.ndarray, row: int, bits: int = CELL_BITS) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((hashes * np.uint64(_ODD[row])) >> np.uint64(64 - bits)).astype(np.int64)


def partial_sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One partition's counters, the zero ones left out; the row number is in the top bits of ``cell``."""
    parts = [np.unique(cells(hashes, r) | (r << CELL_BITS), return_counts=True) for r in range(ROWS)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


class RepeatedFilter:
    """Bitmaps of the counters that reach two; never misses a repeated item."""

    def __init__(self, bits: int, bitmaps: list[np.ndarray]):
        self.bits, self.bitmaps = bits, bitmaps

    def may_repeat(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), dtype=bool)
        for row, bitmap in enumerate(self.bitmaps):
            cell = cells(hashes, row, self.bits)
            out &= (bitmap[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
        return out


class Membership:
    """A bitmap over hashed ids: never misses a listed one, may pass others."""

    def __init__(self, bits: int, bitmap: np.ndarray):
        self.bits, self.bitmap = bits, bitmap

    def may_contain(self, cell: np.ndarray) -> np.ndarray:
        at = cell >> (CELL_BITS - self.bits)
        return (self.bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def cell_of(*columns: str) -> Column:
    """The 31-bit cell of a key, for ``membership``."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - CELL_BITS)


def folded_bits(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(32 * max(n, 1))))))


def _bitmaps(listed: DataFrame, bits: int, rows: int) -> list[np.ndarray]:
    """Bitmaps of (row, cell), folded to the leading ``bits``: at most rows * 2**bits / 8 bytes come to the driver."""
    folded = F.shiftright("cell", CELL_BITS - bits) + 1
    packed = listed.groupBy("row", F.bitmap_bucket_number(folded).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(folded)).alias("bits")).toLocalIterator()
    out = [np.zeros(1 << (bits - 3), dtype=np.uint8) for _ in range(rows)]
    for r in packed:
        at = (r["bucket"] - 1) * 4096
        out[r["row"]][at : at + 4096] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out


def membership(listed: DataFrame) -> Membership:
    """A bitmap of the column ``cell`` (see ``cell_of``), sized by the number of rows."""
    bits = folded_bits(listed.count())
    return Membership(bits, _bitmaps(listed.select(F.lit(0).alias("row"), "cell"), bits, 1)[0])


class Listed:
    """Bitmaps over two parts of uniformly distributed 64-bit numbers: never misses a listed one, may pass others."""

    def __init__(self, bits: int, bitmaps: list[np.ndarray]):
        self.bits, self.bitmaps = bits, bitmaps

    def may_contain(self, numbers: np.ndarray) -> np.ndarray:
        parts = numbers >> np.uint64(64 - CELL_BITS), numbers & np.uint64((1 << CELL_BITS) - 1)
        out = np.ones(len(numbers), dtype=bool)
        for part, bitmap in zip(parts, self.bitmaps, strict=True):
            at = (part >> np.uint64(CELL_BITS - self.bits)).astype(np.int64)
            out &= (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def listed(rows: DataFrame, column: str) -> Listed:
    """``rows`` must be written, as it is read twice; at most 2 * 2**MOST_BITS bits come to the driver."""
    bits = folded_bits(rows.count())
    parts = F.shiftrightunsigned(F.col(column), 64 - CELL_BITS), F.col(column).bitwiseAND((1 << CELL_BITS) - 1)
    both = [rows.select(F.lit(i).alias("row"), part.alias("cell")) for i, part in enumerate(parts)]
    return Listed(bits, _bitmaps(both[0].union(both[1]), bits, 2))


def repeated_filter(partials: DataFrame, label: str) -> RepeatedFilter:
    """Merge partition sketches and fold the counters that reach two into a bitmap of bounded size.

    Folding keeps the leading bits of a cell, so a folded bit is set if any of
    its counters reaches two: that only adds false alarms.
    """
    repeated = written(partials.groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") >= 2), label)
    row, cell = F.shiftright("cell", CELL_BITS).cast("int").alias("row"), F.col("cell").bitwiseAND((1 << CELL_BITS) - 1).alias("cell")
    bits = folded_bits(repeated.count())
    found = RepeatedFilter(bits, _bitmaps(repeated.select(row, cell), bits, ROWS))
    discard(repeated)
    return found
