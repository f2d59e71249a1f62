"""Integer arithmetic on single elements, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of an element and of the fields that go with every block, by variant.
ELEMENT_BYTES = 8
BLOCK_FIELDS = {"rle": 2, "u": 3, "b": 2, "bstar": 2, "classic": 9}


def bit_length(x: Column) -> Column:
    """Binary digits of a non-negative integer, 1 for 0; exact, unlike a logarithm."""
    return F.length(F.bin(x))


def total_bits(lo: Column, hi: Column) -> Column:
    """Bits that tell apart all values of [lo, hi]."""
    return F.when(lo == hi, 1).otherwise(bit_length(hi - lo))


def total_bits_runs(lo: Column, hi: Column) -> Column:
    """The run-based variant's count: one more where the range is a power of two."""
    return F.when(lo == hi, 1).otherwise(bit_length(hi - lo + 1))


def high(x: Column, b: Column) -> Column:
    """x >> b; 0 from 64 on, where a shift of the machine would wrap."""
    return F.when(b >= 64, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftrightunsigned", x, b.cast("int")))


def low(x: Column, b: Column) -> Column:
    """The last b bits of x."""
    return F.when(b >= 63, x).otherwise(x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), b.cast("int")) - 1))


def recombine(base: Column, hi: Column, lo: Column, b: Column) -> Column:
    return base + F.when(b >= 63, lo).otherwise(F.call_function("shiftleft", hi, b.cast("int")).bitwiseOR(lo))


def common_prefix(x: Column, y: Column, bits: Column) -> Column:
    """How many of the first of ``bits`` bits x and y share."""
    return F.when(x == y, bits).otherwise(bits - bit_length(x.bitwiseXOR(y)))


def to_bytes(bits: Column) -> Column:
    """Whole bytes for so many bits."""
    return F.call_function("shiftright", (bits + 7).cast("bigint"), F.lit(3))


def unary(gap: Column) -> Column:
    """Ones as many as the gap, then a zero."""
    return F.concat(F.repeat(F.lit("1"), gap.cast("int")), F.lit("0"))


def unary_inverted(gap: Column) -> Column:
    """Zeros as many as the gap, then a one."""
    return F.concat(F.repeat(F.lit("0"), gap.cast("int")), F.lit("1"))


def clamp_split(x: Column, bits: Column) -> Column:
    """x rounded half away from zero, within [0, bits]; 0 for null (no variation)."""
    rounded = F.round(x).cast("bigint")
    return F.coalesce(F.least(bits, F.greatest(F.lit(0), rounded)), F.lit(0))
