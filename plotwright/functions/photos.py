"""Perceptual hashes as arrays of 64-bit limbs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMBS = 4


def hamming(a: Column, b: Column, limbs: int = LIMBS) -> Column:
    """Differing bits of two hashes."""
    part = lambda i: F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    return reduce(Column.__add__, map(part, range(limbs)))


def same_photos(a: Column, b: Column, threshold: int = 40, limbs: int = LIMBS) -> Column:
    """Whether any hash of one gallery is within ``threshold`` bits of any of the other; false for empty ones."""
    return F.coalesce(F.exists(a, lambda x: F.exists(b, lambda y: hamming(x, y, limbs) <= threshold)), F.lit(False))


def difference_hash(grey: Column, size: int = 16) -> Column:
    """Difference hash of a grey image of ``size`` rows of ``size + 1`` pixels, row by row: bit i tells whether pixel i is darker than its right neighbour."""
    pixel = lambda i, d: F.get(grey, (F.floor(i / size) * (size + 1) + i % size + d).cast("int"))
    limb = lambda k: F.aggregate(
        F.sequence(F.lit(64 * k), F.lit(64 * k + 63)),
        F.lit(0).cast("bigint"),
        lambda acc, i: F.when(pixel(i, 0) < pixel(i, 1), acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), (i - 64 * k).cast("int")))).otherwise(acc),
    )
    return F.array(*[limb(k) for k in range(size * size // 64)])


def limbs_of_decimal(value: int) -> list[int]:
    """A hash stored as one big unsigned number, as signed limbs, lowest first."""
    parts = [(value >> (64 * k)) & (2**64 - 1) for k in range(LIMBS)]
    return [p - 2**64 if p >= 2**63 else p for p in parts]
